"""Training data for a token classifier: labels, histogram, split, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import strip


def token_labels(segments: Column, positive: str = "isnad", separator: int = 0, most: int = 512) -> Column:
    """Labels of the tokens of array<struct<text,type>>: a leading 0, then per segment 1 or 0 for each of its words, cut and padded with 0 to ``most``.

    ``separator`` is the number of tokens that a joined text has between segments; 0 leaves them out, which shifts the
    labels by one per boundary if the text was joined with a separator token.
    """
    words = lambda s: F.size(F.filter(F.split(strip(s["text"]), r"(?U)\s+"), lambda w: w != ""))
    each = F.transform(segments, lambda s, i: F.concat(F.array_repeat(F.lit(0), F.when(i > 0, F.lit(separator)).otherwise(0)), F.array_repeat((s["type"] == positive).cast("int"), words(s))))
    return F.slice(F.concat(F.array(F.lit(0)), F.flatten(each), F.array_repeat(F.lit(0), most)), 1, most)


def joined_text(segments: Column, separator: str = " [SEP] ") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), separator)


def label_histogram(rows: DataFrame, label: str) -> DataFrame:
    """label, n, and percent of all rows."""
    counts = rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def hash_split(key: Column, seed: int = 42, train: float = 0.7, held: float = 0.15) -> Column:
    """train, validation or test by a digest of the key, so that the split needs no shuffle and survives reruns."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(2**32)
    return F.when(u < train, "train").when(u < train + held, "validation").otherwise("test")


def confusion(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    return rows.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def binary_metrics(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: n, accuracy, precision, recall and f1 of class 1 (0 where undefined)."""
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(predicted) == F.col(actual)).alias("same"), F.count_if(p & a).alias("tp"), F.count_if(p).alias("pp"), F.count_if(a).alias("ap"))
    ratio = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(0.0)
    precision, recall = ratio("tp", "pp"), ratio("tp", "ap")
    return sums.select("n", ratio("same", "n").alias("accuracy"), precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"))
