"""Scoring and what follows from it in one pass over the texts: no token goes through a shuffle.

A kernel has a document whole: it cuts the chunks, scores them, numbers the tokens and goes on to positions, clusters and their
text in arrays, so that only the wanted rows leave it. The operators of ``scoring`` and ``boundaries`` do the same for token
tables from elsewhere. Where documents share a doc_id their tokens are numbered together; these take that way here too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import boundaries, scoring
from quillspark.operators.chunks import fixed_chunks
from quillspark.operators.slices import pieces, with_slices

#: Bytes of text whose tokens are held at once, and chunks that a scorer gets at once.
PIECE, GROUP = 1 << 20, 512
#: Repeated doc_ids that may be broadcast; more are joined by a shuffle.
REPEATED = 1_000_000


class Tokens(NamedTuple):
    """Tokens of a list of texts, in order: the text's place in the list, the token's number in the text, absolute offsets."""

    owner: np.ndarray
    number: np.ndarray
    token: pa.Array
    start: np.ndarray
    end: np.ndarray
    pred: np.ndarray
    prob: np.ndarray

    def where(self, kept: np.ndarray) -> Tokens:
        """Those of a mask or at some places."""
        token = self.token.filter(pa.array(kept)) if kept.dtype == bool else self.token.take(pa.array(kept))
        return Tokens(*[token if x is self.token else x[kept] for x in self])


def _counted(owner: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of equal numbers."""
    at = np.arange(len(owner))
    first = np.concatenate([[True], owner[1:] != owner[:-1]])[: len(owner)]
    return at - np.maximum.accumulate(np.where(first, at, 0))


def rounded(values: np.ndarray, digits: int | None) -> np.ndarray:
    """As Spark's ``round``, half up from the decimal form, which costs it more than a token's scoring; None leaves them."""
    if digits is None:
        return values
    scaled = values * 10.0**digits
    out = np.rint(scaled) / 10.0**digits
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def tokens_of(texts: list[str], scorer: scoring.Scorer, stride: int = 500, overlap: int = 50, skip: int = 5) -> Tokens:
    """What ``scoring.token_table`` has of the texts' chunks."""
    of, at = [], []
    for i, text in enumerate(texts):
        starts = range(0, len(text), stride)
        of.extend([i] * len(starts))
        at.extend(starts)
    made, owner, offset = [], np.array(of, np.int64), np.array(at, np.int64)
    for k in range(0, max(len(of), 1), GROUP):
        counts, token, start, end, low, high = scoring.scored_columns(scorer, [texts[i][a : a + stride + overlap] for i, a in zip(of[k : k + GROUP], at[k : k + GROUP], strict=True)])
        chunk = k + np.repeat(np.arange(len(counts)), counts)
        with np.errstate(over="ignore"):
            found = Tokens(owner[chunk], chunk, token, start + offset[chunk], end + offset[chunk], high > low, 1 / (1 + np.exp(low - high)))
        made.append(found.where((offset[chunk] == 0) | (_counted(chunk) >= skip)))
    parts = [pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*made, strict=True)]
    tokens = Tokens(*parts)
    return tokens._replace(number=_counted(tokens.owner))


def positions_of(tokens: Tokens, texts: list[str]) -> Tokens:
    """Boundary tokens within the text, by place; per place the most probable, the first on a tie."""
    length = np.array([len(t) for t in texts], np.int64)
    special = pc.is_in(tokens.token, pa.array(boundaries.SPECIAL_TOKENS)).to_numpy(zero_copy_only=False)
    rows = tokens.where(tokens.pred & ~special & ((tokens.start > 0) | (tokens.start == 0) & (tokens.end != 0)) & (tokens.start <= length[tokens.owner]))
    key = rows.owner << 40 | rows.start
    order = np.argsort(key, kind="stable")
    key, prob = key[order], rows.prob[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    size = np.diff(np.append(begins, len(key)))
    best = np.flatnonzero(prob == np.repeat(np.maximum.reduceat(prob, begins) if len(begins) else prob, size))
    return rows.where(order[best[_counted(key[best]) == 0]])


def _clusters(found: Tokens, gap: int, first: int) -> tuple[np.ndarray, list]:
    """The text of each cluster, and the columns of ``boundaries.gap_clusters`` after doc_id."""
    owner, pos = found.owner, found.start
    begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (pos[1:] - pos[:-1] > gap)])[: len(pos)])
    ends = np.append(begins[1:], len(pos))[: len(begins)]
    size = ends - begins
    shown = np.arange(len(pos)) - np.repeat(begins, size) < first
    tokens = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.minimum(size, first))).astype(np.int32)), found.token.filter(pa.array(shown)))
    top = np.maximum.reduceat(found.prob, begins) if len(begins) else found.prob
    return owner[begins], [_counted(owner[begins]), pos[begins], pos[ends - 1], size, tokens, top]


def _run(docs: DataFrame, load: Callable[[], scoring.Scorer], rows: Callable[[list[str], Tokens], tuple[np.ndarray, list]], schema: str) -> DataFrame:
    """``rows`` gives for the tokens of some texts the text of each row and the columns after doc_id."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = load()
        for batch in batches:
            for part in pieces(batch, 1, PIECE):
                texts = [t or "" for t in part.column(1).to_pylist()]
                owner, columns = rows(texts, tokens_of(texts, scorer))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), *[c if isinstance(c, pa.Array) else pa.array(c) for c in columns]], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + schema)


def _split(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents with a doc_id of their own, and those that share one, if a count finds any."""
    docs = docs.select("doc_id", "text")
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("shared"))
    n = shared.count()
    if not n:
        return docs, None
    shared = F.broadcast(shared) if n <= REPEATED else shared
    same = F.col("doc_id").eqNullSafe(F.col("shared"))
    return docs.join(shared, same, "left_anti"), docs.join(shared, same, "left_semi")


def _table(docs: DataFrame, load: Callable[[], scoring.Scorer]) -> DataFrame:
    return scoring.token_table(scoring.score_chunks(fixed_chunks(docs), load))


def _round(rows: DataFrame, column: str, digits: int | None) -> DataFrame:
    return rows if digits is None else rows.withColumn(column, F.round(column, digits))


def _both(docs: DataFrame, fast: Callable[[DataFrame], DataFrame], shared: Callable[[DataFrame], DataFrame]) -> DataFrame:
    own, rest = _split(docs)
    return fast(own) if rest is None else fast(own).unionByName(shared(rest))


def token_table(docs: DataFrame, load: Callable[[], scoring.Scorer], digits: int | None = None) -> DataFrame:
    """(doc_id, text) -> ``scoring.token_table`` of the scored chunks, with ``digits`` after prob's point."""
    rows = lambda texts, t: (t.owner, [t.number, t.token, t.start, t.end, t.pred.astype(np.int32), rounded(t.prob, digits)])
    fast = lambda d: _run(d, load, rows, "tok_idx long, token string, char_start long, char_end long, pred int, prob double")
    return _both(docs, fast, lambda d: _round(_table(d, load).drop("length"), "prob", digits))


def boundary_tokens(docs: DataFrame, load: Callable[[], scoring.Scorer]) -> DataFrame:
    """(doc_id, text) -> ``scoring.boundary_tokens``; the other tokens stay in the kernel."""

    def rows(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, list]:
        t = tokens.where(tokens.pred)
        return t.owner, [t.number, t.token, t.start]

    return _both(docs, lambda d: _run(d, load, rows, "tok_idx long, token string, char_start long"), lambda d: scoring.boundary_tokens(_table(d, load)))


def inference_stats(docs: DataFrame, load: Callable[[], scoring.Scorer]) -> DataFrame:
    """(doc_id, text) -> ``scoring.inference_stats``; a row of sums per text leaves the kernel."""

    def rows(texts: list[str], t: Tokens) -> tuple[np.ndarray, list]:
        n, hits, total = (np.bincount(t.owner, w, len(texts)) for w in (None, t.pred, t.prob))
        some = np.flatnonzero(n)
        return some, [n[some], hits[some].astype(np.int64), total[some]]

    sums = _run(docs, load, rows, "n long, hits long, total double").groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("total").alias("total"))
    return sums.select("doc_id", F.col("n").alias("total_tokens"), F.col("hits").alias("boundary_tokens"), (100.0 * F.col("hits") / F.col("n")).alias("boundary_percentage"), (F.col("total") / F.col("n")).alias("mean_prob"))


def offset_accuracy(docs: DataFrame, load: Callable[[], scoring.Scorer], first: int = 100) -> DataFrame:
    """(doc_id, text) -> ``scoring.offset_accuracy``; documents without an id have none, as in a join."""
    docs = docs.where("doc_id is not null")

    def rows(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, list]:
        t = tokens.where(tokens.number < first)
        stands = lambda text, word, a, b: 0 <= a and b <= len(text) and text[a:b] == word.lstrip("#")
        same = [stands(texts[i], w, a, b) for i, w, a, b in zip(t.owner.tolist(), t.token.to_pylist(), t.start.tolist(), t.end.tolist(), strict=True)]
        n, right = np.bincount(t.owner, None, len(texts)), np.bincount(t.owner, np.array(same, float), len(texts))
        some = np.flatnonzero(n)
        return some, [n[some], 100.0 * right[some] / n[some]]

    return _both(docs, lambda d: _run(d, load, rows, "n_sampled long, accuracy double"), lambda d: scoring.offset_accuracy(_table(d, load), d, first))


def boundary_positions(docs: DataFrame, load: Callable[[], scoring.Scorer], digits: int | None = None) -> DataFrame:
    """(doc_id, text) -> ``boundaries.boundary_positions``, with ``digits`` after prob's point; documents without an id have none, as in a join."""
    docs = docs.where("doc_id is not null")

    def rows(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, list]:
        found = positions_of(tokens, texts)
        return found.owner, [found.start, rounded(found.prob, digits), found.token]

    return _both(docs, lambda d: _run(d, load, rows, "pos long, prob double, token string"), lambda d: _round(boundaries.boundary_positions(_table(d, load)), "prob", digits))


def gap_clusters(docs: DataFrame, load: Callable[[], scoring.Scorer], gap: int = 20, spans: dict[str, tuple[int, int]] | None = None, first: int = 10, digits: int | None = None) -> DataFrame:
    """(doc_id, text) -> ``boundaries.gap_clusters``, with ``digits`` after max_prob's point, and a column for each (before, after) of ``spans``: the text from so many
    characters before the cluster's start to so many after its end."""
    docs, spans = docs.where("doc_id is not null"), spans or {}

    def rows(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, list]:
        owner, columns = _clusters(positions_of(tokens, texts), gap, first)
        bounds = list(zip(owner.tolist(), columns[1].tolist(), columns[2].tolist(), strict=True))
        cut = [pa.array([texts[i][max(a - before, 0) : b + after] for i, a, b in bounds], pa.string()) for before, after in spans.values()]
        return owner, [*columns[:-1], rounded(columns[-1], digits), *cut]

    def shared(d: DataFrame) -> DataFrame:
        found = boundaries.gap_clusters(boundaries.boundary_positions(_table(d, load)), gap, first)
        found = _round(found, "max_prob", digits)
        return with_slices(found, d, {k: (F.greatest(F.col("char_start") - before, F.lit(0)), F.col("char_end") + after) for k, (before, after) in spans.items()}) if spans else found

    schema = "boundary_id long, char_start long, char_end long, n_tokens long, tokens array<string>, max_prob double"
    return _both(docs, lambda d: _run(d, load, rows, ", ".join([schema, *[f"{k} string" for k in spans]])), shared)
