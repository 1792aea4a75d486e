"""Chat formatting: cumulative-snapshot collapse, then rendering (DataFrame operations only).

A chat log often holds a conversation again and again, each time a few turns longer. Rolling hashes of the turn
prefixes name every prefix; a conversation whose whole is a proper prefix of another one is dropped by an
anti-join, and of equal ones the smallest conv_id stays. The prefixes are deduplicated with map-side combine
before the join, so an opening turn that a third of the log shares is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, table


def _numbered(turns: DataFrame) -> DataFrame:
    """Turns by number, then role and text, as place 1, 2, ...; null fields are empty strings."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


def _rolling(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("place"), F.col("role"), F.col("text"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n, p1, p2): the 128-bit rolling hash of the first ``place`` of ``n`` turns.

    The hash is the running xor of the hashes of (place, role, text), so each turn is hashed once.
    """
    rows = _numbered(turns).select("conv_id", "place", _rolling(1).alias("h1"), _rolling(2).alias("h2"))
    whole = Window.partitionBy("conv_id")
    so_far = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("conv_id", "place", F.count("place").over(whole).alias("n"), F.bit_xor("h1").over(so_far).alias("p1"), F.bit_xor("h2").over(so_far).alias("p2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): the conversations that are no proper prefix of another one, equal ones once."""
    rows = materialize(prefix_hashes(turns), "chat-prefixes")
    whole = rows.where("place = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    parts = rows.where("place < n").select(F.col("place").cast("long").alias("n"), "p1", "p2").distinct()
    return whole.join(parts, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_equal")


def render(turns: DataFrame, template: str = "<|%s|>\n%s<|end|>\n") -> DataFrame:
    """(conv_id, rendered): the turns in order, each through ``template`` with its role and text."""
    rows = _numbered(turns).select("conv_id", "place", F.format_string(template, "role", "text").alias("part"))
    parts = F.sort_array(F.collect_list(F.struct("place", "part")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("rendered"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_equal (how many are equal to it), rendered.

    Defined cases: turns sort by number with null first, ties by role, then text; null role or text is empty; rows
    with a null conv_id are one conversation; repeated rows are turns of their own; an empty table gives no row; extra
    columns are ignored. Very long texts are hashed and rendered whole. A conversation becomes one rendered row, so its turns
    meet in one task; only the turns of conversations that stay are gathered and rendered.
    """
    kept = materialize(maximal_conversations(turns), "chat-kept")
    same = F.col("k.conv_id").eqNullSafe(F.col("t.conv_id"))
    mine = turns.select("conv_id", "turn", "role", "text").alias("t").join(kept.select("conv_id").alias("k"), same, "left_semi")
    rows = kept.alias("k").join(render(mine).alias("t"), same)
    return rows.select("k.conv_id", "n_turns", "n_equal", "rendered")


def op6_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


OP6_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations),
p AS (SELECT conv_id, place, count(*) OVER (PARTITION BY conv_id) AS n,
    md5(string_agg(md5(role || chr(1) || txt), '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h FROM t),
whole AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_equal FROM p WHERE place = n GROUP BY n, h),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = w.n AND p.h = w.h)),
r AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || txt || '<|end|>' || chr(10), '' ORDER BY place) AS rendered FROM t GROUP BY conv_id)
SELECT k.conv_id, k.n::BIGINT AS n_turns, k.n_equal::BIGINT AS n_equal, r.rendered FROM kept k JOIN r ON k.conv_id IS NOT DISTINCT FROM r.conv_id
"""
