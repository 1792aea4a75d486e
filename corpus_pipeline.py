"""The corpus pipeline: from ``documents`` to checksummed blocks of token ids.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the docs of the next. In every
stage texts are used whole, however long; columns beside doc_id, text, lang and source pass through all stages but the last
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontaminate, mixing, neardup, quality, tokens
from quillspark.llm._common import drop_intermediates, materialize, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's limit.

    Null and empty texts stay; a document at the limit stays; a null lang is a language; repeated rows are judged alike.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8), the one of the smallest doc_id.

    Rows with a null doc_id and documents without words stay; rows that repeat doc_id and text become one.
    """
    return neardup.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts stay; null and empty items match nothing; repeated rows are judged alike.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source weights takes them.

    Documents without words aren't taken; a null source is one source, the last; rows that repeat doc_id and text are taken
    or left together.
    """
    return mixing.mix_sources(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written blocks say of each document: doc_id, start, n_tokens, ids_crc32.

    Rows stand in ascending doc_id order, null first, equal doc_ids by text; a null text is the end id alone.
    """
    return tokens.token_round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

#: Perplexity and tokenising are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = written()
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
        drop_intermediates(spark, mark, (docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
