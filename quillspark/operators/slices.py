"""Work that needs a document's text for many of its rows.

A substring expression walks the text from its start for every row, so the records of a long document would cost its
length times their number. Here a document's rows meet its text once, in a kernel that has both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S


def pieces(batch: pa.RecordBatch, column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes of text in ``column`` at most, or one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def per_document(rows: DataFrame, docs: DataFrame, made: list[S.StructField], fill: Callable[[str | None, pa.StructArray], list[list]], drop: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (doc_id, ...) without ``drop`` and with the columns ``made``, which ``fill`` gives for all rows of a document at once.

    Rows of documents that ``docs`` (doc_id, text) doesn't have go, as in a join; the text may be null.
    """
    names = [c for c in rows.columns if c != "doc_id"]
    kept = [c for c in names if c not in drop]
    grouped = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in names])).alias("items"))
    fields = [rows.schema["doc_id"], *[rows.schema[c] for c in kept], *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = S.StructType(fields)
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kinds)
        for batch in batches:
            for part in pieces(batch, 1):
                counts = np.diff(part.column(2).offsets.to_numpy())
                flat, texts, at = part.column(2).flatten(), part.column(1).to_pylist(), 0
                columns: list[list] = [[] for _ in made]
                for text, n in zip(texts, counts.tolist(), strict=True):
                    for column, values in zip(columns, fill(text, flat.slice(at, n)), strict=True):
                        column.extend(values)
                    at += n
                owner = pa.array(np.repeat(np.arange(part.num_rows), counts))
                new = [pa.array(v, schema.field(f.name).type) for v, f in zip(columns, made, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), *[flat.field(names.index(c)) for c in kept], *new], [f.name for f in fields])

    return docs.select("doc_id", "text").join(grouped, "doc_id").select("doc_id", "text", "items").mapInArrow(run, S.StructType(fields))


def with_slices(rows: DataFrame, docs: DataFrame, spans: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """``rows`` (doc_id, ...) with a string column for each (start, end) of ``spans``; no end or a null one is the text's.

    Rows of documents that ``docs`` (doc_id, text) doesn't have go, as in a join; a null text has null slices.
    """
    marks = {f"span {k}": F.struct(a.cast("long").alias("a"), (F.lit(None) if b is None else b).cast("long").alias("b")) for k, (a, b) in spans.items()}

    names = tuple(marks)

    def fill(text: str | None, items: pa.StructArray) -> list[list]:
        out = []
        for name in names:
            span = items.field(items.type.get_field_index(name))
            out.append([None if text is None or a is None else text[max(a, 0) : b] for a, b in zip(span.field(0).to_pylist(), span.field(1).to_pylist(), strict=True)])
        return out

    return per_document(rows.select("*", *[c.alias(k) for k, c in marks.items()]), docs, [S.StructField(k, S.StringType()) for k in spans], fill, names)
