"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Every source gets a target in words. A target of r times the source's words gives each of its documents
``floor(r)`` certain whole copies; the rest is a Pareto order sample of the source's documents: each has a
uniform number U, its rank is the random odds U/(1-U) over its inclusion odds, and documents are taken in
ascending rank until the remaining words are reached. The inclusion odds are a preference (the root of the
size plus one, unless the caller names another) times f/(1-f), f being the remaining fraction; that factor is
the same for a whole source, so it doesn't change the order and is left out.

No source is ever sorted in one place: ranks fall into order-preserving buckets, the words of the buckets are
summed with map-side combine, and only the one bucket of a source that holds the cut is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, small, table, whole_row

WORD = r"[^\x20\x09-\x0D]+"
#: Buckets for a unit of the logarithm of the rank.
FINENESS = 512


def word_count(text: Column) -> Column:
    """Words of a text, long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts like the source by code point, with null last; never null."""
    return F.when(source.isNull(), F.lit("z")).otherwise(F.concat(F.lit("a"), source))


def _odds(seed: int, doc_id: Column, text: Column) -> Column:
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    return u / (F.lit(1.0) - u)


def _ranked(docs: DataFrame, seed: int, preference: Column | None) -> tuple[Column, ...]:
    """(key, size, rank) as columns of ``docs``."""
    size = word_count(docs["text"])
    liked = F.sqrt(size + F.lit(1)) if preference is None else preference
    return source_key(docs["source"]), size, _odds(seed, docs["doc_id"], docs["text"]) / liked


def _bucket(rank: Column) -> Column:
    return F.floor(F.ln(rank) * F.lit(FINENESS)).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(key, source_size) -> also weight and target.

    Sources in key order take the weights in turn and share all words by them. No target is above ``cap`` times
    the source's words; the excess is shared by weight among the others until none is above. With sources sorted
    by cap over weight the capped ones come first, so running sums give the level at which sharing stops. The
    window is over one row per source.
    """
    turn = (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (turn + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(cap))
    by = Window.orderBy(F.col("most") / F.col("weight"), "key")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))).cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(by))
    stop = F.min(F.when(F.col("weight") * F.col("level") <= F.col("most"), F.struct("place", "level"))).over(every)["level"]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.coalesce(stop, F.lit(0.0)))
    return rows.withColumn("target", target).select("key", "source_size", "weight", "target")


def mix_plan(ranked: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(key, size, rank) of all documents -> per source: source_size, target, whole copies and the cut of the sample.

    A document is in the sample if its bucket is below ``cut_bucket``, or is that bucket with a rank up to
    ``cut_rank``. The document at the cut is in if at least half of it fits.
    """
    hist = ranked.groupBy("key", _bucket(F.col("rank")).alias("bucket")).agg(F.sum("size").alias("words"))
    hist = materialize(hist, "mix-buckets")
    sources = source_targets(hist.groupBy("key").agg(F.sum("words").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = materialize(sources, "mix-sources")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = hist.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(small(sources.select("key", "rest")), "key")
    edges = edges.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("key", "bucket", "before", "rest")
    at = ranked.withColumn("bucket", _bucket(F.col("rank"))).join(small(materialize(edges, "mix-edges")), ["key", "bucket"])
    at = at.groupBy("key", "bucket", "before", "rest", "rank").agg(F.sum("size").alias("size"))
    mine = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(mine), F.lit(0)))
    fits = 2 * F.col("start") + F.col("size") <= 2 * F.col("rest")
    cuts = at.groupBy("key").agg(F.first("bucket").alias("cut_bucket"), F.max(F.when(fits, F.col("rank"))).alias("cut_rank"))
    return materialize(sources.join(cuts, "key", "left"), "mix-plan")


def _copies(key: str = "") -> Column:
    bucket = _bucket(F.col("rank"))
    in_sample = F.col("cut_bucket").isNull() | (bucket < F.col("cut_bucket")) | ((bucket == F.col("cut_bucket")) & F.coalesce(F.col("rank") <= F.col("cut_rank"), F.lit(False)))
    return F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + in_sample.cast("long")).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 20240, preference: Column | None = None) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``.

    Reruns agree, as the random numbers are digests of doc_id and text. Defined cases: null text or a text
    without words has size 0 and isn't taken; null doc_id counts as an id; null sources are one source, the last;
    repeated rows share their number and are taken or left together; an empty table gives an empty mix. Columns
    of any other name pass through.
    """
    key, size, rank = _ranked(docs, seed, preference)
    plan = mix_plan(materialize(docs.select(key.alias("key"), size.alias("size"), rank.alias("rank")), "mix-ranks"), weights, cap)
    rows = docs.select(whole_row(docs).alias("row"), key.alias("key"), size.alias("size"), rank.alias("rank"))
    rows = rows.join(small(plan.select("key", "whole", "cut_bucket", "cut_rank")), "key")
    return rows.withColumn("copies", _copies()).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 20240, preference: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), taken (size times copies)."""
    key, size, rank = _ranked(docs, seed, preference)
    ranked = materialize(docs.select("doc_id", "source", key.alias("key"), size.alias("size"), rank.alias("rank")), "mix-ranks")
    plan = mix_plan(ranked.select("key", "size", "rank"), weights, cap)
    rows = ranked.join(small(plan.drop("weight", "rest")), "key")
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents")).drop("source")


OP1_SQL = r"""
WITH ranked AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 'a' || source END AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5('20240|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
sized AS (SELECT *, u / (1.0::DOUBLE - u) / sqrt((size + 1)::DOUBLE) AS rank FROM ranked),
sources AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighted AS (SELECT *, ((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS most FROM sources),
leveled AS (SELECT *, row_number() OVER o AS place,
    (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM weighted
  WINDOW o AS (ORDER BY most::DOUBLE / weight, key), b AS (ORDER BY most::DOUBLE / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT arg_min(level, place) AS level FROM leveled WHERE weight * level <= most),
targets AS (SELECT key, source_size, least(most::DOUBLE, weight * (SELECT level FROM stop)) AS target FROM leveled),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
rests AS (SELECT *, target - whole * source_size AS rest FROM parts),
tied AS (SELECT key, rank, sum(size)::BIGINT AS words FROM sized GROUP BY key, rank),
sums AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY key ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM tied)
SELECT s.doc_id, s.size, r.source_size, r.target,
  CASE WHEN s.size = 0 THEN 0 ELSE s.size * (r.whole + (2 * t.start + t.words <= 2 * r.rest)::BIGINT) END::BIGINT AS taken
FROM sized s JOIN rests r USING (key) JOIN sums t ON t.key = s.key AND t.rank = s.rank
"""
