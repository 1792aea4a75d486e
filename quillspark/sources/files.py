"""Readers and writers of texts, JSON documents, JSON lines and pages; file names and stage tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLUSTERS = "khabar_boundaries array<struct<boundary_id:bigint,char_start:bigint,char_end:bigint,n_tokens:bigint,tokens:array<string>,max_prob:double,text_context:string>>"
RECORDS = "khabars array<struct<id:bigint,char_start:bigint,char_end:bigint,isnad:string,matn:string,isnad_length:bigint,matn_length:bigint,confidence:double>>"
SEGMENTS = "segments array<struct<id:bigint,start:bigint,end:bigint,isnad_text:string,isnad_len:bigint,khabar_len:bigint>>"
UNITS = "narrative_units array<struct<unit_id:bigint,type:string,char_start:bigint,char_end:bigint,has_isnad:boolean,isnad_text:string,text_length:bigint,unit_type:string>>"
INFERENCE = "metadata struct<corpus:string,corpus_size_chars:bigint,total_tokens:bigint>, inference_results struct<total_tokens:bigint,tokens:array<string>,offsets:array<array<bigint>>,predictions:array<bigint>,probabilities:array<double>>"
EXAMPLES = "akhbar_id string, has_isnad boolean, segment_types array<string>, segments array<struct<text:string,type:string>>"


def name_of(path: Column) -> Column:
    """The file name up to its first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): whole UTF-8 files, with CRLF and CR as line ends."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(name_of(F.input_file_name()).alias("name"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def write_texts(docs: DataFrame, path: str) -> None:
    """One file per row of (name, text), in a folder per name; each ends with a line end."""
    docs.select("name", "text").write.mode("overwrite").partitionBy("name").text(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(name, ord, the fields of the array): the one list of JSON documents; a missing list has no row."""
    key = schema.split()[0]
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return docs.select(name_of(F.input_file_name()).alias("name"), F.posexplode(key).alias("ord", "row")).select("name", F.col("ord").cast("long").alias("ord"), "row.*")


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(name, ord, pos) of files that are one JSON array of integers."""
    rows = spark.read.text(path, wholetext=True).select(name_of(F.input_file_name()).alias("name"), F.from_json("value", "array<bigint>").alias("x"))
    return rows.select("name", F.posexplode("x").alias("ord", "pos"))


def read_lines(spark: SparkSession, path: str, schema: str = EXAMPLES) -> DataFrame:
    return spark.read.schema(schema).json(path)


def document(rows: DataFrame, key: str, order: str, metadata: list[Column]) -> DataFrame:
    """(json): one document {metadata, key: rows in order}; nulls are written."""
    fields = [c for c in rows.columns if c != order] if order.startswith("_") else rows.columns
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("r")))), lambda x: x["r"])
    one = rows.agg(F.struct(F.count(F.lit(1)).alias("rows"), *metadata).alias("metadata"), listed.alias(key))
    return one.select(F.to_json(F.struct("metadata", key), {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def find_folder(names: list[str], wanted: str, aliases: dict[str, str]) -> str:
    """The folder that an alias names, or else the first that is the same without case, _ and -."""
    plain = lambda x: x.lower().replace("_", "").replace("-", "")
    if (known := aliases.get(wanted.lower())) in names:
        return known
    for name in names:
        if plain(name) == plain(wanted):
            return name
    raise FileNotFoundError(f"no folder for {wanted!r}; there are {sorted(names)}")


def first_existing(names: list[str], patterns: list[str], text: str) -> str:
    """The first pattern, filled with lower (the small name) and name, that exists."""
    for pattern in patterns:
        if (name := pattern.format(lower=text.lower(), name=text)) in names:
            return name
    raise FileNotFoundError(f"none of {patterns} for {text!r}")


def stage(spark: SparkSession, folder: str, name: str, parameters: dict, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """``build``'s rows from a Parquet folder that is keyed by the stage's parameters, so a changed parameter is never answered by stale rows."""
    digest = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/{name}-{digest}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if force or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
