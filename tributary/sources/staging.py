"""Folders that driver and executors share, and frames written there to cut lineage."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of staged frames that still exist, with what deletes each.
_written: dict[str, functools.partial] = {}


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tributary-")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one if driver and executors are one process; on a
    cluster that raises, since machines don't share their own folders."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _local_dir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(frame: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """The frame, written to the shared folder as Parquet and read again: later steps survive lost executors without redoing it.
    What is written goes with `discard`, at the latest when the driver ends."""
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    _written[path] = functools.partial(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), path)
    writer = frame.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what `staged` wrote for these frames; nothing may read them afterwards."""
    for frame in frames:
        delete = _written.pop(getattr(frame, "_staged_at", None), None)
        if delete:
            delete()


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through the file system that Spark uses for it."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def _delete(jvm, hadoop, path: str) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(hadoop).delete(where, True)


@atexit.register
def _discard_all() -> None:
    for delete in _written.values():
        try:
            delete()
        except Exception:  # the JVM may be gone already; the folder is then left to whoever owns it
            return
