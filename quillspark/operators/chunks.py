"""Cutting texts into overlapping chunks."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.slices import pieces

FIXED = "doc_id long, chunk_id long, start long, end long, text string, length long"


def fixed_chunks(docs: DataFrame, stride: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, text) -> doc_id, chunk_id, start, end, text, length (the whole text's): a chunk every ``stride`` characters,
    ``overlap`` longer; none of an empty text. A kernel cuts each text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FIXED.split(", ")]
        for batch in batches:
            for part in pieces(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                length = np.array([len(t) for t in texts], np.int64)
                count = -(-length // stride)
                owner = np.repeat(np.arange(len(texts)), count)
                number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = number * stride
                end = np.minimum(start + stride + overlap, length[owner])
                cut = pa.array([texts[i][a:b] for i, a, b in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(number), pa.array(start), pa.array(end), cut, pa.array(length[owner])], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FIXED)


def chunk_count(length: Column, stride: int = 500) -> Column:
    return F.floor((length + (stride - 1)) / stride).cast("long")


class Delimiters:
    """Where the delimiters of a text stand, kind by kind."""

    def __init__(self, text: str, kinds: tuple[str, ...]) -> None:
        self.places = [[m.start() for m in re.finditer(re.escape(kind), text)] for kind in kinds]

    def cut(self, low: int, high: int) -> int | None:
        """The place after the last delimiter from ``low`` to before ``high``, of the first kind that is there."""
        for places in self.places:
            before = bisect.bisect_left(places, high)
            if before and places[before - 1] >= low:
                return places[before - 1] + 1
        return None


def smart_bounds(text: str, size: int, overlap: int, least: int, delimiters: tuple[str, ...], back: int = 200) -> list[tuple[int, int]]:
    """(start, end) of chunks of up to ``size`` characters, cut at a delimiter among their last ``back`` where there is one.

    The last chunk reaches the text's end; others shorter than ``least`` are left out, but the walk goes on from them.
    """
    known, bounds, start = Delimiters(text, delimiters), [], 0
    while start + size < len(text):
        end = known.cut(max(start, start + size - back), start + size) or start + size
        bounds.append((start, end))
        start = end - min(overlap, (end - start) // 2)
    whole = [b for b in bounds if b[1] - b[0] >= least]
    return [*whole, (start, len(text))] if text else []


def smart_chunks(docs: DataFrame, size: int = 3500, overlap: int = 500, least: int = 500, delimiters: tuple[str, ...] = ("\n", "।", "،", " ")) -> DataFrame:
    """(doc_id, text) -> doc_id, chunk_id, start, end. The next chunk depends on where the last ended, so a kernel walks each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                found = [smart_bounds(t or "", size, overlap, least, delimiters) for t in part.column(1).to_pylist()]
                owner = pa.array([i for i, b in enumerate(found) for _ in b], pa.int64())
                rows = [(k, a, b) for bounds in found for k, (a, b) in enumerate(bounds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), *[pa.array([r[j] for r in rows], pa.int64()) for j in range(3)]], ["doc_id", "chunk_id", "start", "end"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, chunk_id long, start long, end long")


def workers(chunks: Column) -> Column:
    """How many workers score so many chunks at once."""
    return F.when(chunks <= 2, 1).when(chunks <= 6, F.least(chunks, F.lit(4))).when(chunks <= 20, F.least(chunks, F.lit(6))).otherwise(F.least(chunks, F.lit(8))).cast("long")
