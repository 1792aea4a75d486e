"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (as in tests) gets a folder of
    its own; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of phases that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_written: list[str] = []
_tables: dict[str, str] = {}


def written() -> int:
    """How many tables are written so far: a mark for ``drop_intermediates``."""
    return len(_written)


def note_written(path: str) -> None:
    """Count a folder that an operator wrote itself among the intermediate tables."""
    _written.append(path)


def drop_intermediates(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the tables written after the mark ``since`` but for those that ``materialize`` returned as ``keep``.

    For tables that no result reads any more. Nothing is recomputed from them: what was made of them has been written itself.
    """
    held = {df.__dict__.get("_written_at") for df in keep}
    for name in [p for p in _written[since:] if p not in held]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if name in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(name)}")
        _written.remove(name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    note_written(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_at"] = path
    release(spark)
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``materialize`` in as many buckets of ``key`` as shuffles have partitions, so that a join by it moves the other side alone."""
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{unique}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).format("parquet").option("path", path).saveAsTable(unique.replace("-", "_"))
    note_written(path)
    _tables[path] = unique.replace("-", "_")
    out = spark.table(_tables[path])
    out.__dict__["_written_at"] = path
    release(spark)
    return out


def give_back() -> None:
    """Hand what this process has freed back to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same kernel, which gives freed memory back when its task ends: Python workers live on, several to an executor, and idle ones
    would hold theirs beside those of later stages."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint, if a count proves it to have at most ``rows`` rows.

    Meant for narrow tables that were materialized; beyond the limit the join is left to Spark's shuffles.
    """
    return F.broadcast(df) if df.count() <= rows else df
