"""Queries over ``events`` and the sales tables: positions on a time axis take the place of positions in a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import annotations, boundaries, compare
from quillspark.plans._read import table
from quillspark.plans.documents import stays_sql


def _seconds() -> F.Column:
    return F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1_600_000_000)


def _positions(spark: SparkSession, d: str) -> DataFrame:
    best = Window.partitionBy("doc_id", "pos").orderBy(F.desc("prob"), "event_id")
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("doc_id"), _seconds().alias("pos"), F.col("value").alias("prob"), F.col("event_type").alias("token"))
    return rows.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("doc_id", "pos", "prob", "token")


POSITIONS_SQL = """pos AS (SELECT user_id AS doc_id, epoch_us(ts) // 1000000 - 1600000000 AS pos, value AS prob, event_type AS token FROM events QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 1000000 ORDER BY value DESC, event_id) = 1),
flag AS (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 3600)::INT, 0) AS f FROM pos),
num AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM flag),
cl AS (SELECT doc_id, b::BIGINT AS boundary_id, min(pos)::BIGINT AS char_start, max(pos)::BIGINT AS char_end, count(*) AS n_tokens, list(token ORDER BY pos)[1:10] AS tokens, max(prob) AS max_prob FROM num GROUP BY doc_id, b)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return boundaries.gap_clusters(_positions(spark, d), 3600)


def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).withColumn("tokens", F.array_join("tokens", ","))


def cluster_validation(spark: SparkSession, d: str) -> DataFrame:
    rows = _clusters(spark, d)
    lengths = rows.groupBy("doc_id").agg(F.max("char_end").alias("n"))
    out = boundaries.validate_clusters(rows, lengths)
    return out.withColumn("text_coverage", F.round("text_coverage", 6)).withColumn("mean_gap", F.round("mean_gap", 6))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    start = _seconds()
    header = F.when(F.col("event_type") == "click", F.concat(F.lit("h"), F.col("event_id").cast("string")))
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("unit_id"), F.col("event_id").alias("ord"), start.alias("char_start"), (start + F.floor(F.col("value") * 100).cast("long") + 1).alias("char_end"), header.alias("header_text"))


def merge_intervals(spark: SparkSession, d: str) -> DataFrame:
    return annotations.merge_intervals(_intervals(spark, d)).withColumn("merged_from", F.array_join("merged_from", ","))


def dedup_units(spark: SparkSession, d: str) -> DataFrame:
    rows = _intervals(spark, d)
    tight = rows.withColumn("char_start", F.expr("char_start div 600")).withColumn("char_end", F.expr("char_end div 600"))
    return annotations.dedup_units(tight).select("doc_id", "ord", "char_start", "char_end")


def finalize_units(spark: SparkSession, d: str) -> DataFrame:
    return annotations.finalize_units(_intervals(spark, d)).select("doc_id", "unit_id", "ord", "char_start")


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("detector"), F.col("user_id").alias("key"), _seconds().alias("pos"))


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _sets(spark, d)
    return rows.where("detector = 'click'").select("key", "pos"), rows.where("detector = 'view'").select("key", "pos")


def nearest_match(spark: SparkSession, d: str) -> DataFrame:
    return compare.nearest(*_pair(spark, d))


def _rounded(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, 9) for n in names})


def tolerance_match(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(compare.tolerance_match(*_pair(spark, d), 7200), "precision", "recall", "f1")


def pairwise_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(compare.pairwise(_sets(spark, d), [("click", "view"), ("view", "click"), ("click", "purchase")], 7200), "precision", "recall", "f1")


def scored_match(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(compare.scored_match(*_pair(spark, d), 7200), "precision", "recall", "f1", "mean_distance")


def distance_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(compare.distance_report(*_pair(spark, d), ["key"]), "mean", "stdev")


def order_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The same clustering over a customer's orders, in days."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long").alias("pos"), F.col("o_totalprice").alias("prob"), F.col("o_orderstatus").alias("token"), "o_orderkey")
    best = Window.partitionBy("doc_id", "pos").orderBy(F.desc("prob"), "o_orderkey")
    rows = rows.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return boundaries.gap_clusters(rows, 90).drop("tokens")


QUERIES = {f.__name__: f for f in (gap_clusters, cluster_validation, merge_intervals, dedup_units, finalize_units, nearest_match, tolerance_match, pairwise_scores, scored_match, distance_report, order_clusters)}

_IV = "iv AS (SELECT user_id AS doc_id, event_id AS ord, epoch_us(ts) // 1000000 - 1600000000 AS char_start, epoch_us(ts) // 1000000 - 1600000000 + floor(value * 100)::BIGINT + 1 AS char_end, CASE WHEN event_type = 'click' THEN 'h' || event_id END AS h FROM events)"
_NEAR = "ev AS (SELECT event_type AS detector, user_id AS key, epoch_us(ts) // 1000000 - 1600000000 AS pos FROM events), ids AS (SELECT *, row_number() OVER () AS rid FROM ev), near AS (SELECT a.rid, a.detector AS da, b.detector AS db, a.key, a.pos, min(abs(a.pos - b.pos))::BIGINT AS distance FROM ids a JOIN ids b ON a.key = b.key WHERE (a.detector, b.detector) IN (('click', 'view'), ('view', 'click'), ('click', 'purchase')) GROUP BY ALL)"
_PRF = "SELECT {a} AS a, {b} AS b, na AS n_a, nb AS n_b, m AS matches, round(CASE WHEN na > 0 THEN m / na ELSE 0 END, 9) AS precision, round(CASE WHEN nb > 0 THEN m / nb ELSE 0 END, 9) AS recall, round(CASE WHEN m > 0 THEN 2 * (m / na) * (m / nb) / (m / na + m / nb) ELSE 0 END, 9) AS f1 FROM (SELECT (SELECT count(*) FROM ev WHERE detector = {a}) AS na, (SELECT count(*) FROM ev WHERE detector = {b}) AS nb, (SELECT count(*) FROM near WHERE da = {a} AND db = {b} AND distance <= 7200) AS m)"

ORACLES = {
    "dedup_units": f"WITH RECURSIVE {_IV}, tight AS (SELECT doc_id, ord AS o, char_start // 600 AS s, char_end // 600 AS e, coalesce(len(h), 0) AS n FROM iv), {stays_sql('tight')} SELECT t.doc_id, t.o AS ord, t.s AS char_start, t.e AS char_end FROM tight t JOIN stays ON stays.doc_id = t.doc_id AND stays.o = t.o",
    "gap_clusters": f"WITH {POSITIONS_SQL} SELECT * REPLACE (array_to_string(tokens, ',') AS tokens) FROM cl",
    "cluster_validation": f"WITH {POSITIONS_SQL}, g AS (SELECT *, lead(char_start) OVER (PARTITION BY doc_id ORDER BY char_start) - char_end AS gap FROM cl) SELECT doc_id, count(*) AS total_boundaries, round(sum(char_end - char_start)::DOUBLE / max(char_end) * 100, 6) AS text_coverage, min(gap) AS min_gap, max(gap) AS max_gap, list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1] AS median_gap, round(avg(gap), 6) AS mean_gap, count(*) FILTER (gap < 50) AS very_short, count(*) FILTER (gap > 5000) AS very_long FROM g GROUP BY doc_id",
    "merge_intervals": f"WITH {_IV}, o AS (SELECT *, row_number() OVER w AS r, coalesce((char_start >= max(char_end) OVER (PARTITION BY doc_id ORDER BY char_start, char_end DESC, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS f FROM iv WINDOW w AS (PARTITION BY doc_id ORDER BY char_start, char_end DESC, ord)), i AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY r) AS isl FROM o), m AS (SELECT doc_id, isl, min(char_start)::BIGINT AS char_start, max(char_end)::BIGINT AS char_end, arg_max(h, r) FILTER (h IS NOT NULL) AS header_text, CASE WHEN count(*) > 1 THEN string_agg(ord::VARCHAR, ',' ORDER BY r) END AS merged_from FROM i GROUP BY doc_id, isl) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1)::BIGINT AS unit_id, char_start, char_end, header_text, header_text IS NOT NULL AS has_header, merged_from FROM m",
    "finalize_units": f"WITH {_IV} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY char_start, char_end, ord) - 1)::BIGINT AS unit_id, ord, char_start FROM iv",
    "nearest_match": f"WITH {_NEAR} SELECT e.key, e.pos, n.distance FROM ids e LEFT JOIN near n ON n.rid = e.rid AND n.da = 'click' AND n.db = 'view' WHERE e.detector = 'click'",
    "tolerance_match": f"WITH {_NEAR} SELECT n_a, n_b, matches, precision, recall, f1 FROM ({_PRF.format(a=chr(39) + 'click' + chr(39), b=chr(39) + 'view' + chr(39))})",
    "pairwise_scores": f"WITH {_NEAR} " + " UNION ALL ".join(_PRF.format(a=f"'{a}'", b=f"'{b}'") for a, b in (("click", "view"), ("view", "click"), ("click", "purchase"))),
    "scored_match": f"WITH {_NEAR}, p AS (SELECT (SELECT count(*) FROM ev WHERE detector = 'click') AS pc, (SELECT count(*) FROM ev WHERE detector = 'view') AS gc, count(*) AS tp, quantile_cont(distance, 0.5) AS md, avg(distance) AS me FROM near WHERE da = 'click' AND db = 'view' AND distance <= 7200) SELECT pc AS predicted_count, gc AS gold_count, tp AS true_positives, pc - tp AS false_positives, gc - tp AS false_negatives, round(tp / pc, 9) AS precision, round(tp / gc, 9) AS recall, round(2 * (tp / pc) * (tp / gc) / (tp / pc + tp / gc), 9) AS f1, md::DOUBLE AS median_distance, round(me, 9) AS mean_distance FROM p",
    "distance_report": f"WITH {_NEAR}, l AS (SELECT key, list_sort(list(distance)) AS x FROM near WHERE da = 'click' AND db = 'view' GROUP BY key) SELECT key, x[1] AS min, x[len(x) // 4 + 1] AS q25, x[len(x) // 2 + 1] AS median, x[3 * len(x) // 4 + 1] AS q75, x[-1] AS max, round(list_avg(x), 9) AS mean, round(list_stddev_samp(x), 9) AS stdev, len(list_filter(x, lambda v: v <= 20))::BIGINT AS within_20, len(list_filter(x, lambda v: v <= 50))::BIGINT AS within_50, len(list_filter(x, lambda v: v <= 100))::BIGINT AS within_100, len(list_filter(x, lambda v: v <= 500))::BIGINT AS within_500 FROM l",
    "order_clusters": "WITH p AS (SELECT o_custkey AS doc_id, date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS pos, o_totalprice AS prob FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_totalprice DESC, o_orderkey) = 1), f AS (SELECT *, coalesce((pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 90)::INT, 0) AS f FROM p), n AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM f) SELECT doc_id, b::BIGINT AS boundary_id, min(pos)::BIGINT AS char_start, max(pos)::BIGINT AS char_end, count(*) AS n_tokens, max(prob) AS max_prob FROM n GROUP BY doc_id, b",
}
