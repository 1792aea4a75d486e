"""An extension: the row-local part of the engine over a stream of document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.clean import clean
from quillspark.operators.segments import Segmenter, marker_segments


def segment_stream(spark: SparkSession, path: str, segmenter: Segmenter, schema: str = "doc_id long, text string") -> DataFrame:
    """Parquet documents as they arrive under ``path``, cleaned and segmented."""
    docs = spark.readStream.schema(schema).parquet(path)
    return marker_segments(docs.select("doc_id", clean(F.col("text")).alias("text")), segmenter)


def write_segments(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, exactly once, as Parquet."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def position_clusters(events: DataFrame, gap: str = "20 seconds", late: str = "10 minutes") -> DataFrame:
    """(key, ts, value): the stream's form of gap clustering, as session windows that close behind the watermark."""
    rows = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "max_value")
