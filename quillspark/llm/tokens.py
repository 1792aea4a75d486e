"""Token-ID output: tokenise whole documents, write checksummed blocks, read them back.

A file set is a folder of Parquet files whose rows are blocks (see ``_codec``), numbered by part and block in
ascending doc_id order, so Spark's own commit protocol makes a write whole and any store that Spark reads will do.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _codec
from . import _text as T
from ._common import materialize, note_written, release, returning, shared_dir, small, table

#: Ids after which a block is closed, at the end of a document.
BLOCK_IDS = 1 << 21
#: Distinct units whose ids a worker remembers at once, about 25 bytes each.
REMEMBERED = 4_000_000
BLOCKS = "part int, block int, n_ids long, data binary"


def word_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Marks that stand in one piece after a letter, apart from it.
MARKS = np.zeros(256, bool)
MARKS[list(b".,;:!?*$%&#")] = True
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


class UnitIds:
    """Ids of texts under a lower-casing tokenizer with word ends that drops white space and splits off runs of letters.

    Such a tokenizer gives a text the ids of its words one after another, so each distinct word is encoded once. Marks at
    the end of a word are a piece of their own if a letter stands before them; then word and marks are two units. Units are known by
    64-bit hashes with A-Z as a-z; only words with a <, which may hold special tokens, are known by their exact bytes.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix = spec["model"]["end_of_word_suffix"]
        plain = [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": plain}}
        self.plain = Tokenizer.from_str(json.dumps(spec))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, how many each has).

        A unit of small, composed letters alone is one piece that normalizer and splitter leave as it is: many such are
        encoded as one text by the same model without them, and cut where a piece ends.
        """
        texts = [u.decode() for u in units]
        simple = [i for i, t in enumerate(texts) if t.isalpha() and (t == t.lower() if not t.isascii() else t.islower()) and (t.isascii() or unicodedata.is_normalized("NFC", t))]
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(units)
        others = set(range(len(units))).difference(simple)
        for at in range(0, len(simple), 256):
            some = simple[at : at + 256]
            ids = np.array(self.plain.encode(" ".join([texts[i] for i in some]), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids])[:-1] + 1
            if len(cuts) + 1 != len(some):
                others.update(some)
                continue
            for i, x in zip(some, np.split(ids, cuts), strict=True):
                found[i] = x
        rest = sorted(others)
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            found[i] = np.array(x.ids, np.uint32)
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, starts, ends) of the units of all rows."""
        starts, ends = T.spans(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint64), starts, ends
        stem, open_ = ends.copy(), np.arange(len(ends))
        for _ in range(16):
            open_ = open_[MARKS[data[stem[open_] - 1]]]
            stem[open_] -= 1
            open_ = open_[stem[open_] > starts[open_]]
            if not len(open_):
                break
        else:  # long runs of marks
            last = np.maximum.accumulate(np.where(MARKS[data], -1, np.arange(len(data))))
            stem = np.maximum(last[ends - 1] + 1, starts)
        byte, before = data[np.maximum(stem - 1, 0)], data[np.maximum(stem - 2, 0)]
        letter = LETTERS[byte] | ((byte >= 0x80) & (before == 0xC3) & (byte != 0x97) & (byte != 0xB7))
        split = (stem > starts) & (stem < ends) & letter
        if (data == 0x3C).any():
            angles = np.append(0, np.cumsum(data == 0x3C))
            split &= angles[ends] == angles[starts]
        at = np.flatnonzero(split)
        starts, ends = np.insert(starts, at + 1, stem[at]), np.insert(ends, at, stem[at])
        hashes = T.span_hash(T.prefix_sums(T.LOWER[data]), starts, ends)
        if (data == 0x3C).any():
            exact = angles[ends] != angles[starts]
            hashes[exact] = T.mix(T.span_hash(T.prefix_sums(data), starts[exact], ends[exact]) ^ T.MULTIPLIERS[7])
        return hashes, starts, ends

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by row) of a column of texts."""
        data, offsets = T.utf8(column)
        hashes, starts, ends = self.units(data, offsets)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            units = [raw[a:b] if b"<" in raw[a:b] else raw[a:b].lower() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            ids, count = self.learn(units)
            entry = np.arange(len(count)) + len(self.starts) - 1
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(count)])
            self.ids = np.concatenate([self.ids, ids])
            self.hashes, self.entry = np.insert(self.hashes, at[new], distinct[new]), np.insert(self.entry, at[new], entry)
            at = np.searchsorted(self.hashes, distinct)
        entry = self.entry[at][where]
        begin = self.starts[entry]
        count = self.starts[entry + 1] - begin
        place = np.append(0, np.cumsum(count))
        ids = self.ids[np.arange(place[-1]) + np.repeat(begin - place[:-1], count)]
        return ids, place[np.searchsorted(starts, offsets)]


@functools.cache
def _unit_ids(path: str) -> UnitIds:
    """One for the life of a Python worker."""
    return UnitIds(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """(doc_id, text) -> blocks at ``path``: every whole text's ids and ``end_id``, in ascending doc_id order (null first).

    Null text is empty; equal doc_ids stand in the order of their texts; an empty table has no block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part, block = _unit_ids(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal block, size
            name = pa.concat_arrays([h[0] for h in held])
            null = name.is_null().to_numpy(zero_copy_only=False)
            data = _codec.write_block(name.fill_null(0).to_numpy(), null, np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([size]), pa.array([data], pa.binary())], ["part", "block", "n_ids", "data"])
            block, size = block + 1, 0
            held.clear()
            return out

        for batch in batches:
            for piece in T.pieces(batch, "text"):
                ids, offsets = units.encode(piece.column(1))
                count = np.diff(offsets)
                ended = np.full(len(ids) + len(count), end_id, np.uint32)
                ended[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
                held.append((piece.column(0), count + 1, ended))
                size += len(ended)
                if size >= BLOCK_IDS:
                    yield close()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(returning(run), BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the blocks at ``path``: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, null, counts, ids = _codec.read_block(batch.column(2)[i].as_py())
                raw = ids.astype("<u4")
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(starts, ends, strict=True)], np.int64)
                n = len(counts)
                columns = [pa.array(np.full(n, batch.column(0)[i].as_py()), pa.int32()), pa.array(np.full(n, batch.column(1)[i].as_py()), pa.int32()), pa.array(doc_ids, mask=null), pa.array(starts), pa.array(counts), pa.array(crc)]
                kinds = ["part", "block", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids)))
                    kinds.append("ids")
                yield pa.RecordBatch.from_arrays(columns, kinds)

    blocks = spark.read.schema(BLOCKS).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per task that wrote
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("part", "block", F.coalesce(inside, F.lit(0)).alias("inside")).join(parts, "part").select("part", "block", (F.col("base") + F.col("inside")).alias("before"))
    offsets = materialize(offsets, "token-offsets")
    rows = blocks.select("part", "block", "data").mapInArrow(returning(run), "part int, block int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return rows.join(small(offsets), ["part", "block"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes the documents' ids to the shared folder and returns what the files say of them (see ``read_tokens``)."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer or word_tokenizer(), end_id)
    note_written(path)
    release(spark)
    return read_tokens(spark, path)


def op9_context_mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(table(spark, sf_dir, "documents"))
