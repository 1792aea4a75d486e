"""Comparing boundary sets with a tolerance: nearest neighbours, precision and recall, distance reports.

The nearest neighbour comes from one sort of both sets per key, never from pairing them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, pos) and (key, pos) -> every row of ``a`` with the distance to the nearest position of ``b``, null if it has none."""
    both = a.select("key", "pos", F.lit(True).alias("asks")).unionByName(b.select("key", "pos", F.lit(False).alias("asks")))
    own = F.when(~F.col("asks"), F.col("pos"))
    order = Window.partitionBy("key").orderBy("pos")
    back = F.max(own).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(own).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    return both.select("key", "pos", "asks", F.least(F.col("pos") - back, ahead - F.col("pos")).alias("distance")).where("asks").drop("asks")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def tolerance_match(a: DataFrame, b: DataFrame, tolerance: int = 80) -> DataFrame:
    """One row: n_a, n_b, matches (rows of ``a`` within the tolerance of some row of ``b``), precision, recall, f1.

    Several rows may match the same one, so recall can pass 1.
    """
    hits = nearest(a, b).agg(F.count(F.lit(1)).alias("n_a"), F.count_if(F.col("distance") <= tolerance).alias("matches"))
    rows = hits.join(F.broadcast(b.agg(F.count(F.lit(1)).alias("n_b"))))
    p, r = _ratio(F.col("matches"), F.col("n_a")), _ratio(F.col("matches"), F.col("n_b"))
    return rows.select("n_a", "n_b", "matches", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def pairwise(sets: DataFrame, pairs: list[tuple[str, str]], tolerance: int = 80) -> DataFrame:
    """(detector, key, pos) -> ``tolerance_match`` of every named pair."""
    out = None
    for x, y in pairs:
        pick = lambda d: sets.where(F.col("detector") == d).select("key", "pos")
        row = tolerance_match(pick(x), pick(y), tolerance).select(F.lit(x).alias("a"), F.lit(y).alias("b"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def scored_match(predicted: DataFrame, gold: DataFrame, tolerance: int = 80) -> DataFrame:
    """One row: predicted and gold counts, true and false positives, misses, precision, recall, f1, median and mean distance of the matches."""
    near = F.when(F.col("distance") <= tolerance, F.col("distance"))
    sums = nearest(predicted, gold).agg(F.count(F.lit(1)).alias("predicted_count"), F.count(near).alias("true_positives"), F.percentile(near, 0.5).alias("median_distance"), F.avg(near).alias("mean_distance"))
    rows = sums.join(F.broadcast(gold.agg(F.count(F.lit(1)).alias("gold_count"))))
    tp = F.col("true_positives")
    p, r = _ratio(tp, F.col("predicted_count")), _ratio(tp, F.col("gold_count"))
    return rows.select("predicted_count", "gold_count", "true_positives", (F.col("predicted_count") - tp).alias("false_positives"), (F.col("gold_count") - tp).alias("false_negatives"), p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"), "median_distance", "mean_distance")


def distance_report(a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Directed distances from ``a`` to ``b``: least, index quartiles, greatest, mean, deviation, and counts within 20, 50, 100, 500.

    Distances are counted before they are ordered, so a hot key costs as many rows as it has different distances.
    """
    keys = by or []
    cells = nearest(a, b).where("distance is not null").groupBy(*keys, "distance").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy(*keys)
    cells = cells.withColumn("upto", F.sum("c").over(whole.orderBy("distance"))).withColumn("n", F.sum("c").over(whole))
    at = lambda num, den: F.min(F.when(F.col("upto") > F.floor(F.col("n") * num / den), F.col("distance")))
    n, total = F.sum("c"), F.sum(F.col("distance") * F.col("c"))
    mean = F.sum(F.col("distance") * F.col("c")).over(whole) / F.col("n")
    cells = cells.withColumn("off", F.pow(F.col("distance") - mean, F.lit(2.0)) * F.col("c"))
    spread = F.when(n > 1, F.sqrt(F.sum("off") / (n - 1)))
    out = cells.groupBy(*keys).agg(
        F.min("distance").alias("min"), at(1, 4).alias("q25"), at(1, 2).alias("median"), at(3, 4).alias("q75"), F.max("distance").alias("max"), (total / n).alias("mean"), spread.alias("stdev"),
        *[F.coalesce(F.sum(F.when(F.col("distance") <= k, F.col("c"))), F.lit(0)).alias(f"within_{k}") for k in (20, 50, 100, 500)],
    )
    return out
