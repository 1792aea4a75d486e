"""Exact repeats of long byte strings by bucket-pointer refinement.

Which positions start a 200-byte string that also starts elsewhere? Every position begins in the bucket of its first q bytes. A
bucket pointer of depth h is refined by the pointer of depth h that stands h bytes later, which names its next h bytes: the
pair is the pointer of depth 2 h. The new pointers are reused the same way, so depth 200 takes three rounds over the positions of
a text. Pointers are 64-bit hashes of pairs of pointers instead of places in a sorted order, so that tasks agree on them without a
global sort; what is sorted are the pointers of a bucket that is not resolved.

Of all positions only a few go through the shuffles:

1. Every window of LENGTH bytes goes with its least first pointer (its bucket), at the first place where it has it.
   Neighbouring windows mostly share it, so a text is a short list of segments: runs of windows with one such place.
2. A bucket with one segment in the whole table is resolved. A bucket with more is refined by the deep pointers of the segment's
   first and last window, which name all that the segment covers: segments with equal ones repeat in full.
3. In a bucket of unlike segments (where copies begin, end or were edited) the windows are cut into blocks of BLOCK,
   counted from the q-gram, so that equal windows stand in equal blocks. The string that all windows of a block share
   is the next bucket, the deep pointers of its ends refine it, and step 2 is applied again: a block whose shared string
   comes once is resolved, and so are blocks with equal pointers.
4. What is left, a few blocks at each edge, goes on with the deep pointers of its single windows.

A content that many segments have goes down once. All counts are aggregated before the shuffle, then joined back, where Spark
splits skewed keys; no bucket is ever collected. Equal means equal bucket and equal pointers, 128 bits together; documents are known
by 128 bits of their id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._common import drop_intermediates, materialize, small, table, written

LENGTH, Q, BLOCK = 200, 48, 16
#: Texts asked for whose keys may be broadcast; more are joined by a shuffle.
ASKED = 500_000
_FAR = np.uint64(2**64 - 1)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i:i + width] for each i that has so many."""
    n = len(values)
    if n < width:
        return values[:0]
    full = -(-n // width) * width
    padded = np.full(full, _FAR)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def pointers(data: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """(pointers of depth q, of depth ``length``) of all positions that have so many bytes; each round combines pointers with later ones."""
    sums = T.prefix_sums(data)
    at = np.arange(len(data) - q + 1)
    first = now = T.span_hash(sums, at, at + q)
    depth = q
    while depth < length:
        step = min(depth, length - depth)
        now = T.mix(now[:-step] * T.MULTIPLIERS[10] + now[step:] * T.MULTIPLIERS[11] + np.uint64(step))
        depth += step
    return first, now


def _covered(deep: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """What the windows from ``first`` to ``last`` cover, by the pointers of these two, which overlap or touch."""
    return T.mix(deep[first] * T.MULTIPLIERS[12] + deep[last] * T.MULTIPLIERS[13] + (last - first).astype(np.uint64))


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, place of the q-gram, bucket, id) of the segments of all rows; windows are counted in their row."""
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    none = np.zeros(0, np.int64)
    if not windows.any():
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams, deep = pointers(data, length, q)
    width = length - q + 1
    least = sliding_minimum(grams, width)
    valid = np.zeros(len(least) + 1, bool)
    edges = np.zeros(len(least) + 1, np.int32)
    has = windows > 0
    np.add.at(edges, offsets[:-1][has], 1)
    np.add.at(edges, (offsets[:-1] + windows)[has], -1)
    valid = edges.cumsum() > 0
    valid[-1] = False
    new = valid.copy()
    new[1:-1] &= ~valid[:-2] | (least[1:] != least[:-1])
    new[offsets[:-1][has]] = True
    first = np.flatnonzero(new)
    stop = valid[:-1] & (~valid[1:] | new[1:])
    last = np.flatnonzero(stop)
    bucket = least[first]
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    again = np.empty(len(first), bool)
    place = np.empty(len(first), np.int64)
    for a in range(0, len(first), 8192):
        part = slice(a, a + 8192)
        place[part] = (view[first[part]] == bucket[part, None]).argmax(1) + first[part]
        again[part] = place[part] != width - 1 - (view[last[part]] == bucket[part, None])[:, ::-1].argmax(1) + last[part]
    if again.any():  # one segment for each place of the q-gram: the windows in which it is the first
        a, b, x = first[again], last[again], bucket[again]
        size = b - a + width
        of = np.repeat(np.arange(len(a)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + a[of]
        hit = grams[at] == x[of]
        of, at = of[hit], at[hit]
        after = np.append(False, of[1:] == of[:-1])
        start = np.where(after, np.append(0, at[:-1]) + 1, a[of])
        end = np.minimum(at, b[of])
        some = start <= end
        keep = ~again
        first, last, place, bucket = (np.concatenate([u[keep], v[some]]) for u, v in ((first, start), (last, end), (place, at), (bucket, x[of])))
    row = np.searchsorted(offsets, first, "right") - 1
    return row, first - offsets[row], last - offsets[row], place - offsets[row], bucket, _covered(deep, first, last)


RUN = "did long, th long, bucket long, id long, first int, last int, place int, own boolean"


def _runs(part: pa.RecordBatch, row, bucket, ids, first, last, place, own) -> pa.RecordBatch:
    take = pa.array(row)
    columns = [part.column(0).take(take), part.column(1).take(take), pa.array(bucket.view(np.int64)), pa.array(ids.view(np.int64))]
    columns += [pa.array(x.astype(np.int32)) for x in (first, last, place)] + [pa.array(own)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RUN.split(", ")])


def _segments(length: int, q: int):
    """(did, th, text) -> the segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "text"):
                row, first, last, place, bucket, ids = segments(*T.utf8(part.column(2)), length, q)
                yield _runs(part, row, bucket, ids, first, last, place, np.ones(len(row), bool))

    return run


def _finer(length: int, q: int, block: int):
    """(did, th, text, parts) -> the parts cut into blocks of windows, by what they share and what they cover; at 1 into windows, whose bucket is their first pointer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "text", 1 << 19):
                data, offsets = T.utf8(part.column(2))
                grams, deep = pointers(data, length, q)
                lists = part.column(3)
                owner = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                first, last, place, own = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                first, last, place = (x.astype(np.int64) for x in (first, last, place))
                low = (first - place) // block
                n = (last - place) // block - low + 1
                at = np.repeat(np.arange(len(n)), n)
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[at]
                place, rows = place[at], owner[at]
                start, end = np.maximum(first[at], place + k * block), np.minimum(last[at], place + k * block + block - 1)
                base = offsets[rows]
                if block > 1:
                    covered = T.mix(_covered(deep, base + start, base + end) + (start - place).view(np.uint64) * T.MULTIPLIERS[8])
                    shared = T.span_hash(T.prefix_sums(data), base + place + k * block + block - 1, base + place + k * block + length)
                    shared = T.mix(shared + k.view(np.uint64) * T.MULTIPLIERS[9])
                else:
                    shared, covered = grams[base + start], deep[base + start]
                yield _runs(part, rows, shared, covered, start, end, place, own[at])

    return run


def _refine(runs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Runs with bucket and id -> (runs that repeat in full, contents to refine further).

    A bucket of one run is done. Equal ids in a bucket repeat; of each content in a bucket of unlike ones, one run goes on
    (``own``: its result is wanted, as no equal one has been found for it).
    """
    counted = runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    counted = counted.where("n > 1").select("bucket", (F.col("low") != F.col("high")).alias("unlike"))
    hits = materialize(runs.join(materialize(counted, f"{name}-buckets"), "bucket"), name)
    one = F.min(F.struct("did", "th", "first", "last", "place")).alias("one")
    whole = hits.groupBy("bucket", "id").agg(F.count(F.lit(1)).alias("n"), F.max("unlike").alias("unlike"), F.max("own").alias("own"), one)
    whole = materialize(whole, f"{name}-contents")
    full = hits.where("own").join(whole.where("n > 1").select("bucket", "id"), ["bucket", "id"]).select("did", "th", "first", "last")
    return full, whole.where("unlike").select("one.did", "one.th", F.struct("one.first", "one.last", "one.place", (F.col("own") & (F.col("n") == 1)).alias("own")).alias("part"))


def _with_texts(texts: DataFrame, parts: DataFrame) -> DataFrame:
    gathered = parts.groupBy("did", "th").agg(F.collect_list("part").alias("parts"))
    return texts.join(gathered, ["did", "th"]).select("did", "th", "text", "parts")


def removed_spans(data: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """(did, th, text) -> (did, th, spans): the windows' starts as runs [first, last], each window covering ``length`` bytes."""
    mark = written()
    full, parts = _refine(data.mapInArrow(_segments(length, q), RUN), "segments")
    parts = materialize(parts, "parts")
    asked = materialize(parts.select("did", "th").distinct(), "asked")
    texts = materialize(data.join(small(asked, ASKED), ["did", "th"]).dropDuplicates(["did", "th"]), "texts")
    blocks = _with_texts(texts, parts).mapInArrow(_finer(length, q, min(BLOCK, length)), RUN)
    more, rest = _refine(blocks, "blocks")
    rest = materialize(rest, "rest")
    windows = materialize(_with_texts(texts, rest).mapInArrow(_finer(length, q, 1), RUN).select("did", "th", "bucket", "id", "first", "own"), "windows")
    shared = windows.groupBy("bucket", "id").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own")).where("n > 1 and own").select("bucket", "id")
    single = windows.where("own").join(materialize(shared, "shared-windows"), ["bucket", "id"]).select("did", "th", "first", F.col("first").alias("last"))
    spans = full.unionByName(more).unionByName(single)
    spans = materialize(spans.groupBy("did", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    drop_intermediates(data.sparkSession, mark, (spans,))
    return spans


def merge_spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte runs [start, end) covered by windows of ``length`` bytes that start from ``first`` to ``last``."""
    order = np.argsort(first, kind="stable")
    start, end = first[order].astype(np.int64), last[order].astype(np.int64) + length
    reach = np.maximum.accumulate(end)
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch, "text"):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                lists = part.column(2)
                size, removed, runs, digest, rest, spans = [], [], [], [], [], []
                for i, text in enumerate(texts):
                    text = text or b""
                    kept, found = text, []
                    if lists[i].is_valid and len(lists[i]):
                        own = lists[i].values
                        start, end = merge_spans(own.field(0).to_numpy(), own.field(1).to_numpy(), length)
                        found = list(zip(start.tolist(), end.tolist(), strict=True))
                        kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True))
                    size.append(len(text))
                    removed.append(len(text) - len(kept))
                    runs.append(len(found))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        rest.append(kept)
                        spans.append([{"start": a, "end": b} for a, b in found])
                columns = [part.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    columns += [pa.array(rest, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                    names += ["kept", "spans"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, q: int = Q, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary) and spans.

    A byte goes if some string of ``length`` bytes that covers it also starts anywhere else in the input. Defined cases:
    null text is empty; texts shorter than ``length`` bytes lose nothing; rows are told apart by 128 bits of doc_id and text, so
    any number of them may share a doc_id or have none; repeated rows are copies of each other and lose all if long enough; very long
    texts are one text like others; there are no ties, as every copy goes; an empty table gives no row; extra columns are ignored.
    """
    if not 0 < q <= length:
        raise ValueError("q must be between 1 and length")
    name = (F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text"))
    data = docs.select(F.xxhash64(F.lit(1), *name).alias("did"), F.xxhash64(F.lit(2), *name).alias("th"), name[0].alias("doc_id"), "text")
    spans = removed_spans(data.select("did", "th", "text").where(F.octet_length("text") >= length), length, q)
    extra = ", kept binary, spans array<struct<start long, end long>>" * with_text
    rows = data.join(spans, ["did", "th"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + extra)


def op3_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
