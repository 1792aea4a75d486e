"""Benchmark decontamination: every passage of the corpus is a query to a BM25 index of the benchmark.

The index is built once for a shard of the benchmark, whose size is checked, and goes to the tasks; texts are scanned where they
are and never shuffled. A larger benchmark is cut into shards, of which a scan searches several; term weights are those of the
whole benchmark in every shard, so that scores don't depend on the cut.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._bm25 import Index, unit_terms
from ._common import materialize, table, whole_row

#: Bytes of item texts in a shard of the index, about; one longer item is a shard.
SHARD_BYTES = 8 << 20
#: Shards that a scan of the texts searches together; all of them are in the memory of a task.
SCAN_SHARDS = 4
THRESHOLD = 0.6


def index_shards(benchmark: DataFrame, threshold: float = THRESHOLD, shard_bytes: int = SHARD_BYTES) -> Iterator[Broadcast]:
    """Broadcast indexes that together hold every item with a text."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // shard_bytes)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, shards))).cast("int"))
    if shards > 1:
        terms = materialize(items.select("shard", "text").mapInArrow(_terms, "shard int, term long, words long"), "benchmark-terms")
        total, words = terms.agg(F.count_if(F.col("words") > 0), F.sum("words")).first()
        having = materialize(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "benchmark-having")
    for k in range(shards):
        rows = items.where(F.col("shard") == k).orderBy("item_id", "text").collect()
        statistics = None
        if shards > 1 and total:
            mine = having.join(terms.where(F.col("shard") == k).select("term").distinct(), "term").toArrow()
            known = mine.column("term").combine_chunks().to_numpy(zero_copy_only=False).view("uint64").tolist()
            statistics = (total, words / total, dict(zip(known, mine.column("n").to_pylist(), strict=True)))
        yield benchmark.sparkSession.sparkContext.broadcast(Index([r[0] for r in rows], [r[1] for r in rows], threshold, statistics))


def _scans(benchmark: DataFrame, threshold: float, shard_bytes: int = SHARD_BYTES) -> Iterator[list[Broadcast]]:
    """The indexes in groups that one scan of the texts searches together."""
    shards = index_shards(benchmark, threshold, shard_bytes)
    while some := list(itertools.islice(shards, SCAN_SHARDS)):
        yield some


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, text) -> one row per unit and distinct term, the unit's number of words at its first."""
    for batch in batches:
        for part in T.pieces(batch, "text"):
            row, words, terms = unit_terms(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(terms.view("int64")), pa.array(words)], ["shard", "term", "words"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, score, question_overlap, answer_overlap.

    Passages are 128 words, every 64 words; words are runs of letters and digits, A-Z lower-cased. All units of an item
    (64 words) that score ``threshold`` of their own score or more are retrieved, and the item is a leak if enough of
    its question's and its answer's word runs are in the document. Defined cases: null or empty texts and items match
    nothing; repeated items are found each; repeated rows give repeated results; null ids are passed on; extra columns are ignored;
    very long texts are searched whole; a passage that ties with the threshold is retrieved; an empty table gives no row.
    """
    spark = docs.sparkSession
    kind = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], kind)

    def searcher(indexes: list[Broadcast]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in T.pieces(batch, "text"):
                    hits = [h for index in indexes for h in index.value.search(part.column(1))]
                    ids = part.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([h[1] for h in hits], pa.int64()), *[pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4)]], [c.split()[0] for c in kind.split(", ")])

        return run

    for some in _scans(benchmark, threshold):
        found = found.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(searcher(some), kind))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which ``find_leaks`` finds nothing, columns as they are."""

    def leaks(indexes: list[Broadcast]):
        @F.arrow_udf("boolean")
        def leaked(text: pa.Array) -> pa.Array:
            out = []
            for part in T.pieces(pa.RecordBatch.from_arrays([text], ["text"]), "text"):
                rows = {h[0] for index in indexes for h in index.value.search(part.column(0))}
                out += [i in rows for i in range(part.num_rows)]
            return pa.array(out, pa.bool_())

        return leaked

    rows = docs.select(whole_row(docs).alias("row"), "text")
    for some in _scans(benchmark, threshold):
        rows = rows.where(~leaks(some)("text"))
    return rows.select("row.*")


def op8_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
