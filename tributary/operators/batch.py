"""Batch strategies of the inner join. All return the same rows; they differ in the physical join that Spark runs."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.predicate import Predicate
from tributary.sources.staging import fresh_path

#: A side is broadcast only when both Catalyst's estimate of it and its measured size are below this.
BROADCAST_LIMIT = 64 << 20
#: How much larger rows may be in memory than Catalyst's estimate, which takes compressed files at their size on disk.
INFLATION = 8
#: A hash table per partition above this would not fit an executor's task memory; the join then sorts, which spills.
HASH_BUILD_LIMIT = 256 << 20


def estimated_bytes(frame: DataFrame) -> int:
    """Catalyst's size estimate of the optimized plan (of files, their size on disk)."""
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def measured_bytes(frame: DataFrame) -> int:
    """The size of all rows in memory, from one aggregation over them: what fixed types take, and the bytes of strings and
    nested values."""
    fixed, sums = 16, []
    for field in frame.schema.fields:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            sums.append(F.sum(F.octet_length(column).cast("bigint")))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            sums.append(F.sum(F.octet_length(F.to_json(F.struct(column))).cast("bigint")))
        fixed += 16
    row = frame.agg(F.count(F.lit(1)).alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
    return row.n * fixed + sum(x or 0 for x in row[1:])


def _needs_keys(pred: Predicate, name: str) -> None:
    if not pred.has_keys:
        raise ValueError(f"{name} needs equality keys; use a nested-loop strategy for other conditions")


def nested_loop(left: DataFrame, right: DataFrame, pred: Predicate) -> DataFrame:
    """Any predicate; every pair of partitions meets in one task, so both sides may be large."""
    b = pred.bind(left, right)
    return b.finish(b.first.join(b.second.hint("shuffle_replicate_nl"), b.condition))


def block_nested_loop(left: DataFrame, right: DataFrame, pred: Predicate, block_rows: int | None = None, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Any predicate against a right side that is held whole, while its size is under `broadcast_limit`: Catalyst's estimate
    first, then, where that is small, as measured over its rows;
    above that, as nested_loop. `block_rows` is accepted as a hint and does not change the result."""
    if block_rows is not None and block_rows <= 0:
        raise ValueError("block_rows must be positive")
    b = pred.bind(left, right, hide_equality=True)
    if estimated_bytes(b.second) > broadcast_limit or measured_bytes(b.second) > broadcast_limit:
        return nested_loop(left, right, pred)
    return b.finish(b.first.join(b.second.hint("broadcast"), b.condition))


def sort_merge(left: DataFrame, right: DataFrame, pred: Predicate, memory_rows: int | None = None) -> DataFrame:
    """Sorts both sides by key, spilling as needed. `memory_rows` is a hint only."""
    _needs_keys(pred, "sort_merge")
    if memory_rows is not None and memory_rows <= 0:
        raise ValueError("memory_rows must be positive")
    b = pred.bind(left, right)
    return b.finish(b.first.join(b.second.hint("merge"), b.condition))


def simple_hash(left: DataFrame, right: DataFrame, pred: Predicate, memory_rows: int | None = None, build_limit: int = HASH_BUILD_LIMIT) -> DataFrame:
    """Builds a hash table of each left partition and probes it with the right side. Where the estimated left
    partition is above `build_limit`, the join sorts instead, since hash tables cannot spill."""
    _needs_keys(pred, "simple_hash")
    if memory_rows is not None and memory_rows <= 0:
        raise ValueError("memory_rows must be positive")
    b = pred.bind(left, right)
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if INFLATION * estimated_bytes(b.first) / parts > build_limit:
        return sort_merge(left, right, pred)
    return b.finish(b.first.hint("shuffle_hash").join(b.second, b.condition))


def write_presorted(frame: DataFrame, table: str, keys: list[str], buckets: int = 8) -> DataFrame:
    """Saves a table in hash buckets, one sorted file each, for ordered_merge; its files go to a folder of their own in the
    shared folder, so what earlier sessions left does not matter."""
    writer = frame.repartition(buckets, *keys).write.mode("overwrite").option("path", fresh_path(frame.sparkSession, table))
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return frame.sparkSession.table(table)


@contextmanager
def bucket_order_trusted(spark: SparkSession) -> Iterator[None]:
    """While it lasts, scans of one-file buckets count as sorted, so that an ordered merge run inside neither shuffles nor sorts."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def ordered_merge(left: DataFrame, right: DataFrame, pred: Predicate) -> DataFrame:
    """Merges inputs that are already dealt and sorted by key (see write_presorted). Other inputs give the same rows, sorted first."""
    _needs_keys(pred, "ordered_merge")
    if left.sparkSession.conf.get("spark.sql.sources.bucketing.enabled") != "true":
        warnings.warn("bucketing is off; ordered_merge will shuffle", stacklevel=2)
    return sort_merge(left, right, pred)
