"""Token scoring: a scorer interface, logits to probabilities, absolute offsets, inference statistics."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillspark.operators.slices import per_document

TOKEN = "tok int, token string, start int, end int, logit0 double, logit1 double"


class Scorer(Protocol):
    """Scores many chunks at once: for each, its tokens as (token, start, end, logit of no boundary, logit of boundary)."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, int, int, float, float]]]: ...


@functools.lru_cache(maxsize=200_000)
def _logits(word: str) -> tuple[float, float]:
    digest = hashlib.md5(word.encode()).hexdigest()
    return int(digest[:8], 16) % 997 / 100, int(digest[8:16], 16) % 997 / 100


@functools.lru_cache(maxsize=100_000)
def _digest(word: bytes) -> bytes:
    return hashlib.md5(word).digest()


class HashScorer:
    """A deterministic stand-in for a model: ASCII words and single other characters with logits from their md5, in [CLS] and [SEP]."""

    words = re.compile("[0-9A-Za-z]+|[^0-9A-Za-z \t\n\r\f\v]")

    def __call__(self, texts: list[str]) -> list[list[tuple[str, int, int, float, float]]]:
        return [[("[CLS]", 0, 0, 1.0, 0.0), *((m.group(), m.start(), m.end(), *_logits(m.group())) for m in self.words.finditer(t)), ("[SEP]", 0, 0, 1.0, 0.0)] for t in texts]

    def columns(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same as arrays: tokens of each text, and for all of them token, start, end and the logits.

        The tokens' bytes are the texts' own without the blanks, so no token is made by itself; each distinct one is hashed once.
        """
        raw = "".join([f"[CLS]{t}[SEP]" for t in texts]).encode()
        kind, data = np.frombuffer(raw.translate(_KINDS), np.uint8), raw.translate(None, b" \t\n\r\f\v")
        last = np.cumsum([len(t.encode()) + 10 for t in texts], dtype=np.int64)
        first = np.append(0, last)[:-1]
        begins = (kind == 1) | (kind == 2)
        begins[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
        for mark in (first, last - 5):
            for k in range(1, 5):
                begins[mark + k] = False
        place = np.flatnonzero(begins)
        offsets = np.append(np.flatnonzero(begins[kind > 0]), len(data))
        token = pa.StringArray.from_buffers(len(place), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
        until = np.searchsorted(place, last)
        counts = np.diff(until, prepend=0)
        rest = np.cumsum(kind == 3, dtype=np.int32) if len(data) and kind.max() == 3 else np.zeros(len(kind), np.int32)
        start = place - rest[place]
        start -= np.repeat(start[until - counts] + 5, counts)
        end = start + np.where(kind[place] == 1, np.diff(offsets), 1)
        known = token.dictionary_encode()
        _, ends, words = known.dictionary.buffers()
        ends, words = np.frombuffer(ends, np.int32)[: len(known.dictionary) + 1].tolist(), words.to_pybytes() if words else b""
        digests = b"".join([_digest(words[a:b]) for a, b in itertools.pairwise(ends)])
        logits = (np.frombuffer(digests, ">u4").reshape(-1, 4)[:, :2] % 997 / 100)[known.indices.to_numpy()]
        for mark in (until - counts, until - 1):
            start[mark] = end[mark] = 0
            logits[mark] = 1, 0
        return counts, token, start, end, logits[:, 0], logits[:, 1]


#: By UTF-8 byte: 0 for a blank, 1 in a word, 2 the first of a token by itself, 3 its others.
_KINDS = bytes(0 if chr(c) in " \t\n\r\f\v" else 1 if c < 128 and chr(c).isalnum() else 3 if 128 <= c < 192 else 2 for c in range(256))


def scored_columns(scorer: Scorer, texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, and for all of them token, start, end and the logits; from a scorer's ``columns``, if it has them."""
    if hasattr(scorer, "columns"):
        return scorer.columns(texts)
    scored = scorer(texts)
    token, *numbers = zip(*[t for x in scored for t in x], strict=True) if any(scored) else [()] * 5
    kinds = (np.int64, np.int64, float, float)
    return np.array([len(x) for x in scored], np.int64), pa.array(token, pa.string()), *[np.array(n, k) for n, k in zip(numbers, kinds, strict=True)]


def score_chunks(chunks: DataFrame, load: Callable[[], Scorer]) -> DataFrame:
    """(doc_id, chunk_id, start, text) -> one row per token with the chunk's start as chunk_start, and the chunk's length if it has one.

    ``load`` runs once per task in the worker, so a model is read there from its path and scores a batch at a time.
    """

    extra = ["length"] if "length" in chunks.columns else []
    names = ["doc_id", "chunk_id", "chunk_start", *extra, *[c.split()[0] for c in TOKEN.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                counts, *columns = scored_columns(scorer, [t or "" for t in part.column(len(extra) + 3).to_pylist()])
                owner = pa.array(np.repeat(np.arange(len(counts)), counts))
                place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
                made = [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(owner) for k in range(len(extra) + 3)], pa.array(place.astype(np.int32)), *made], names)

    kept = chunks.select(F.col("doc_id").cast("long"), F.col("chunk_id").cast("long"), F.col("start").cast("long"), *[F.col(c).cast("long") for c in extra], "text")
    return kept.mapInArrow(run, "doc_id long, chunk_id long, chunk_start long, " + "length long, " * len(extra) + TOKEN)


def argmax(logits: Column) -> Column:
    """Index of the first greatest element."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("long")


def softmax(logits: Column) -> Column:
    """The greatest element and the total are bound as variables, so that they aren't found anew for every element."""
    bound = lambda value, body: F.transform(F.array(value), body)[0]
    shifted = bound(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return bound(shifted, lambda e: bound(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: x / total)))


def token_table(scored: DataFrame, skip: int = 5) -> DataFrame:
    """Scored tokens -> doc_id, tok_idx, token, char_start, char_end, pred, prob in absolute offsets.

    The first ``skip`` tokens of every chunk but the first are the overlap's and go. A tie of the logits predicts 0. The length of
    the text stays with its tokens if the chunks had it.
    """
    rows = scored.where((F.col("chunk_id") == 0) | (F.col("tok") >= skip))
    order = Window.partitionBy("doc_id").orderBy("chunk_id", "tok")
    return rows.select(
        "doc_id", (F.row_number().over(order) - 1).cast("long").alias("tok_idx"), "token",
        (F.col("start") + F.col("chunk_start")).alias("char_start"), (F.col("end") + F.col("chunk_start")).alias("char_end"),
        (F.col("logit1") > F.col("logit0")).cast("int").alias("pred"), (1 / (1 + F.exp(F.col("logit0") - F.col("logit1")))).alias("prob"), *(["length"] if "length" in scored.columns else []),
    )


def tokens_from_arrays(doc_id: Column, result: Column, raw: DataFrame) -> DataFrame:
    """Parallel arrays tokens, offsets, predictions, probabilities -> the token table; the shortest array ends the rows."""
    n = F.least(*[F.size(result[k]) for k in ("tokens", "offsets", "predictions", "probabilities")])
    rows = raw.select(doc_id.alias("doc_id"), F.posexplode(F.slice(F.arrays_zip(*[result[k].alias(k) for k in ("tokens", "offsets", "predictions", "probabilities")]), F.lit(1), n)).alias("tok_idx", "t"))
    return rows.select("doc_id", F.col("tok_idx").cast("long").alias("tok_idx"), F.col("t.tokens").alias("token"), F.col("t.offsets")[0].alias("char_start"), F.col("t.offsets")[1].alias("char_end"), F.col("t.predictions").cast("int").alias("pred"), F.col("t.probabilities").alias("prob"))


def same_length(result: Column) -> Column:
    """Whether the four arrays are of one length."""
    size = F.size(result["tokens"])
    return (size == F.size(result["offsets"])) & (size == F.size(result["predictions"])) & (size == F.size(result["probabilities"]))


def inference_stats(tokens: DataFrame) -> DataFrame:
    """Per document: tokens, boundary tokens, their percentage (0 without tokens), mean probability."""
    n, hits = F.count(F.lit(1)), F.sum("pred").cast("long")
    return tokens.groupBy("doc_id").agg(n.alias("total_tokens"), hits.alias("boundary_tokens"), F.when(n > 0, 100.0 * hits / n).otherwise(0.0).alias("boundary_percentage"), F.avg("prob").alias("mean_prob"))


def boundary_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.where("pred = 1").select("doc_id", "tok_idx", "token", "char_start")


def offset_accuracy(tokens: DataFrame, docs: DataFrame, first: int = 100) -> DataFrame:
    """Per document: among the first tokens, the percentage whose text stands at their offsets (leading # of the token ignored)."""

    def fill(text: str | None, items: pa.StructArray) -> list[list]:
        token, start, end = (items.field(items.type.get_field_index(c)).to_pylist() for c in ("token", "char_start", "char_end"))
        text = text or ""
        return [[0 <= a and b <= len(text) and text[a:b] == t.lstrip("#") for t, a, b in zip(token, start, end, strict=True)]]

    rows = tokens.where(F.col("tok_idx") < first).select("doc_id", "token", "char_start", "char_end")
    rows = per_document(rows, docs, [S.StructField("same", S.BooleanType())], fill)
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sampled"), (100.0 * F.count_if("same") / F.count(F.lit(1))).alias("accuracy"))
