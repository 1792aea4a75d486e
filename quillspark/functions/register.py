"""Names for SQL: the operators that work inside one text, as functions and table functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillspark.operators.chunks import smart_bounds
from quillspark.operators.segments import Segmenter, normalize

DELIMITERS = ("\n", "।", "،", " ")


def normalize_text(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else normalize(t) for t in text.to_pylist()], pa.string())


class Chunks:
    """chunks(text, size, overlap, least): chunk_id, start, end of the chunks cut at delimiters; none of a null or empty text."""

    def eval(self, text: str, size: int, overlap: int, least: int) -> Iterator[tuple[int, int, int]]:
        for k, (start, end) in enumerate(smart_bounds(text or "", size, overlap, least, DELIMITERS)):
            yield k, start, end


class Segments:
    """segments(text): id, start, end, header, header_len, body_len of the default segmenter's segments."""

    def __init__(self) -> None:
        self.segmenter = Segmenter()

    def eval(self, text: str) -> Iterator[tuple]:
        yield from self.segmenter.segments(text) if text else ()


def register(spark: SparkSession, prefix: str = "quill_") -> list[str]:
    """Registers quill_normalize(text) and the table functions quill_chunks and quill_segments; returns the names."""
    spark.udf.register(f"{prefix}normalize", F.arrow_udf(normalize_text, "string"))
    spark.udtf.register(f"{prefix}chunks", F.udtf(Chunks, returnType="chunk_id: bigint, start: bigint, end: bigint"))
    spark.udtf.register(f"{prefix}segments", F.udtf(Segments, returnType="id: bigint, start: bigint, end: bigint, header: string, header_len: bigint, body_len: bigint"))
    return [prefix + n for n in ("normalize", "chunks", "segments")]
