"""Connected components of a link table by alternating large and small stars.

Each round is two shuffles of the links; links shrink toward stars around the smallest id of a component, and
the rounds end when nothing changes, after about log2 of the longest path. No neighbour list is ever collected:
minima are aggregated with map-side combine and joined back, so a node with very many links is no group of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_intermediates, materialize, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    least = materialize(least, "least")  # written, so that Spark can split the links of a hub
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) long, not null -> (id, component_id) for every id in a link of two different ids, the component being its smallest id."""
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while True:
        mark = written() - 1  # the links of the round before
        now = materialize(_small_star(_large_star(now)), "links")
        drop_intermediates(links.sparkSession, mark, (now,))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).distinct()
        seen = state
