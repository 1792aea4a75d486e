"""Boundary positions: dedup, gap clustering, validation. All by windows over doc_id, so one exchange serves the chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import upper_median
from quillspark.operators.slices import with_slices

SPECIAL_TOKENS = ("[PAD]", "[CLS]", "[SEP]", "[UNK]")


def boundary_positions(tokens: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Token table -> (doc_id, pos, prob, token): boundary tokens within the text, per position the most probable, the first on a tie.

    ``docs`` (doc_id, text) is read for the texts' lengths only if the tokens don't carry them.
    """
    rows = tokens.where(F.col("pred") == 1).where(~F.col("token").isin(*SPECIAL_TOKENS)).where("not (char_start = 0 and char_end = 0) and char_start >= 0")
    if docs is not None and "length" not in tokens.columns:
        rows = rows.join(docs.select("doc_id", F.length("text").alias("length")), "doc_id")
    if "length" in rows.columns:
        rows = rows.where(F.col("char_start") <= F.col("length"))
    best = Window.partitionBy("doc_id", "char_start").orderBy(F.desc("prob"), "tok_idx")
    return rows.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("doc_id", F.col("char_start").alias("pos"), "prob", "token")


def gap_clusters(positions: DataFrame, gap: int = 20, first: int = 10) -> DataFrame:
    """(doc_id, pos, prob, token) -> clusters of positions at most ``gap`` apart, numbered from 0.

    A cluster ends at the start of its last position. ``tokens`` are its first ones in order.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(order) > gap).cast("int"), F.lit(0))
    rows = positions.withColumn("new", new).withColumn("boundary_id", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    tokens = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("pos", "token"))), 1, first), lambda x: x["token"])
    return rows.groupBy("doc_id", F.col("boundary_id").cast("long").alias("boundary_id")).agg(
        F.min("pos").cast("long").alias("char_start"), F.max("pos").cast("long").alias("char_end"), F.count(F.lit(1)).alias("n_tokens"), tokens.alias("tokens"), F.max("prob").alias("max_prob")
    )


def with_context(clusters: DataFrame, docs: DataFrame, before: int = 40, after: int = 80) -> DataFrame:
    """Clusters with the text around them."""
    start = F.greatest(F.col("char_start") - before, F.lit(0))
    return with_slices(clusters, docs, {"text_context": (start, F.col("char_end") + after)})


def validate_clusters(clusters: DataFrame, lengths: DataFrame) -> DataFrame:
    """Per document of ``lengths`` (doc_id, n): clusters, coverage in percent, and the gaps between them.

    The gap columns are null with fewer than two clusters; coverage of an empty text is 0.
    """
    following = F.lead("char_start").over(Window.partitionBy("doc_id").orderBy("char_start", "boundary_id"))
    rows = clusters.select("doc_id", "char_start", "char_end", (following - F.col("char_end")).alias("gap"))
    sums = rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_boundaries"), F.sum(F.col("char_end") - F.col("char_start")).alias("span"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
        upper_median(F.collect_list("gap")).alias("median_gap"), F.avg("gap").alias("mean_gap"), F.count_if(F.col("gap") < 50).alias("very_short"), F.count_if(F.col("gap") > 5000).alias("very_long"),
    )
    coverage = F.when(F.col("n") > 0, F.coalesce("span", F.lit(0)) / F.col("n") * 100).otherwise(0.0)
    return lengths.join(sums, "doc_id", "left").select("doc_id", F.coalesce("total_boundaries", F.lit(0)).cast("long").alias("total_boundaries"), coverage.alias("text_coverage"), "min_gap", "max_gap", "median_gap", "mean_gap", "very_short", "very_long")


def mid_word_boundaries(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document with clusters: how many start inside the text with neither neighbour a space or line end."""
    at = F.col("char_start")
    rows = with_slices(clusters.select("doc_id", "char_start"), docs, {"around": (at - 1, at + 1)})
    inside = (at > 0) & (F.length("around") == 2) & ~F.col("around").rlike("[ \n]")
    return rows.groupBy("doc_id").agg(F.count_if(inside).alias("mid_word_boundaries"))
