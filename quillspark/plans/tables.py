"""Queries over ``embeddings``, ``labels`` and ``conversations``: logits, metrics, training labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import scoring, training
from quillspark.plans._read import table


def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    logits = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").select("vec_id", logits.alias("x"))
    return rows.select("vec_id", scoring.argmax(F.col("x")).alias("best"), F.round(F.array_max(scoring.softmax(F.col("x"))), 9).alias("prob"))


def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return training.label_histogram(table(spark, d, "labels"), "quality").withColumn("percent", F.round("percent", 9))


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id", training.hash_split(F.col("doc_id")).alias("part"))


def binary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return training.binary_metrics(table(spark, d, "labels"), "quality", "toxic").select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return training.confusion(table(spark, d, "labels"), "quality", "toxic")


def token_labels(spark: SparkSession, d: str) -> DataFrame:
    """Turns as segments, the user's as the positive ones."""
    segment = F.struct(F.col("text"), F.col("role").alias("type"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", segment.alias("s")))), lambda x: x["s"]).alias("segments"))
    labels = training.token_labels(F.col("segments"), "user")
    return rows.select("conv_id", F.aggregate(labels, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_positive"), F.md5(F.array_join(labels, "")).alias("digest"), F.md5(training.joined_text(F.col("segments"))).alias("text_digest"))


QUERIES = {f.__name__: f for f in (softmax_argmax, label_histogram, hash_split, binary_metrics, confusion_matrix, token_labels)}

ORACLES = {
    "softmax_argmax": "WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), e AS (SELECT vec_id, x, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM x) SELECT vec_id, (list_position(x, list_max(x)) - 1)::BIGINT AS best, round(list_max(e) / list_sum(e), 9) AS prob FROM e",
    "label_histogram": "SELECT quality AS label, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM labels), 9) AS percent FROM labels GROUP BY quality",
    "hash_split": "WITH u AS (SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM labels) SELECT doc_id, CASE WHEN u < 0.7::DOUBLE THEN 'train' WHEN u < 0.85::DOUBLE THEN 'validation' ELSE 'test' END AS part FROM u",
    "binary_metrics": "WITH s AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS e, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1) AS pp, count(*) FILTER (toxic = 1) AS ap FROM labels) SELECT n, round(e / n, 9) AS accuracy, round(tp / pp, 9) AS precision, round(tp / ap, 9) AS recall, round(2 * (tp / pp) * (tp / ap) / (tp / pp + tp / ap), 9) AS f1 FROM s",
    "confusion_matrix": "SELECT toxic AS actual, quality AS predicted, count(*) AS n FROM labels GROUP BY ALL",
    "token_labels": r"WITH t AS (SELECT conv_id, turn, text, role, repeat(CASE WHEN role = 'user' THEN '1' ELSE '0' END, len(regexp_extract_all(text, '[^\s]+'))) AS l FROM conversations), c AS (SELECT conv_id, left('0' || string_agg(l, '' ORDER BY turn), 512) AS l, string_agg(text, ' [SEP] ' ORDER BY turn) AS x FROM t GROUP BY conv_id) SELECT conv_id, len(replace(l, '0', ''))::BIGINT AS n_positive, md5(rpad(l, 512, '0')) AS digest, md5(x) AS text_digest FROM c",
}
