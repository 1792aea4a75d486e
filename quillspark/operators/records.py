"""Records and units: greedy spacing, header and body slices, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import strip
from quillspark.operators.segments import header_prefix
from quillspark.operators.slices import with_slices


def spaced(boundaries: DataFrame, least: int = 50) -> DataFrame:
    """Boundaries at least ``least`` after the last kept one, counting from 0; sorted by start, then ``ord`` (boundary_id).

    The choice carries state from row to row, so a document's boundaries fold in one sorted array, from which the kept ones
    come out whole.
    """
    names = [c for c in boundaries.columns if c != "doc_id"]
    item = F.struct(F.col("char_start").alias("a"), F.col("boundary_id").alias("b"), F.struct(*names).alias("row"))
    grouped = boundaries.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    places = F.aggregate(
        F.transform("items", lambda x, i: F.struct(x["a"].cast("long").alias("a"), i.alias("i"))),
        F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<int>").alias("kept")),
        lambda s, x: F.when(x["a"] - s["last"] >= least, F.struct(x["a"].alias("last"), F.array_append(s["kept"], x["i"]).alias("kept"))).otherwise(s),
    )["kept"]
    rows = grouped.select("doc_id", F.explode(F.transform(places, lambda i: F.get("items", i)["row"])).alias("row"))
    return rows.select("doc_id", "row.*").select(boundaries.columns)


def build_records(boundaries: DataFrame, docs: DataFrame, least: int = 50, least_header: int = 5) -> DataFrame:
    """Boundaries -> doc_id, id, char_start, char_end, header, body, header_length, body_length, confidence.

    The body runs to the next kept boundary or the text's end. A record with a short header is dropped with its text; the
    ids are dense after that. char_end is the boundary's end plus the stripped body's length.
    """
    order = Window.partitionBy("doc_id").orderBy("char_start", "boundary_id")
    rows = spaced(boundaries, least).withColumn("next", F.lead("char_start").over(order))
    rows = rows.select("doc_id", "boundary_id", "char_start", "char_end", "max_prob", "next")
    rows = with_slices(rows, docs, {"header": (F.col("char_start"), F.col("char_end")), "body": (F.col("char_end"), F.col("next"))})
    rows = rows.withColumn("header", strip(F.col("header"))).withColumn("body", strip(F.col("body")))
    rows = rows.where(F.length("header") >= least_header)
    n = lambda c: F.length(c).cast("long")
    return rows.select(
        "doc_id", (F.row_number().over(order) - 1).cast("long").alias("id"), "char_start", (F.col("char_end") + n("body")).alias("char_end"),
        "header", "body", n("header").alias("header_length"), n("body").alias("body_length"), F.col("max_prob").alias("confidence"),
    )


def record_totals(records: DataFrame) -> DataFrame:
    """One row: records, sums and averages of the lengths, 0 when there are none."""
    some = lambda f, c, kind: F.coalesce(f(c), F.lit(0)).cast(kind)
    return records.agg(F.count(F.lit(1)).alias("n_records"), *[some(F.sum, f"{p}_length", "long").alias(f"total_{p}") for p in ("header", "body")], *[some(F.avg, f"{p}_length", "double").alias(f"avg_{p}") for p in ("header", "body")])


def narrative_units(spans: DataFrame, docs: DataFrame, unit_id: str = "boundary_id", start: str = "char_start", end: str = "char_end", **header) -> DataFrame:
    """Spans of boundaries or segments -> units with the header found at the start of the span's own text."""
    rows = spans.select("doc_id", F.col(unit_id).alias("unit_id"), F.col(start).alias("char_start"), F.col(end).alias("char_end"))
    return units_of_spans(with_slices(rows, docs, {"span": (F.col("char_start"), F.col("char_end"))}), **header)


def units_of_spans(rows: DataFrame, **header) -> DataFrame:
    """(doc_id, unit_id, char_start, char_end, span) -> units; ``span`` is the text from char_start to char_end."""
    rows = rows.withColumn("header_text", header_prefix(F.col("span"), **header))
    return rows.select("doc_id", "unit_id", F.lit("record").alias("type"), "char_start", "char_end", F.col("header_text").isNotNull().alias("has_header"), "header_text", F.length("span").cast("long").alias("text_length"))


def unit_source(boundaries: DataFrame | None, segments: DataFrame | None, docs: DataFrame, **header) -> DataFrame:
    """Units of exactly one of the two inputs."""
    if (boundaries is None) == (segments is None):
        raise ValueError("give either boundaries or segments")
    if boundaries is not None:
        return narrative_units(boundaries, docs, **header)
    return narrative_units(segments, docs, "id", "start", "end", **header)


def unit_summary(units: DataFrame) -> DataFrame:
    return units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_units"), F.count_if("has_header").alias("n_with_header"))
