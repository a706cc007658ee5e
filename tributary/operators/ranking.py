"""Row numbers that no single task has to compute alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.functions.names import free_names
from tributary.sources.staging import staged

#: Bits of monotonically_increasing_id that count the rows of a partition.
_ROW_BITS = 33


def row_numbers(frame: DataFrame, keys: list[Column], order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """`frame` with a 1-based row number within equal `keys` (over all rows if there are none), by `order`.

    Rows are dealt by ranges of (keys, order) and sorted, so one hot key spreads over many tasks; a row's place in its range is
    its number there. They are written once. Only a row for each range, and with keys one for each key in a range, is
    aggregated afterwards. Nulls come first in `order`; rows tied in it are numbered in any order.
    """
    spark = frame.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at, part, index, ahead, rows, first, *helpers = free_names([*frame.columns, name], "at", "part", "index", "ahead", "rows", "first", *(f"k{i}" for i in range(len(keys))), *(f"o{i}" for i in range(len(order))))
    ks, os = helpers[: len(keys)], helpers[len(keys) :]
    dealt = frame.select("*", *(k.alias(a) for k, a in zip(keys, ks, strict=True)), *(o.alias(a) for o, a in zip(order, os, strict=True)))
    by = [F.col(c) for c in (*ks, *os)]
    dealt = dealt.repartitionByRange(n, *by).sortWithinPartitions(*by).drop(*os).withColumn(at, F.monotonically_increasing_id())
    dealt = staged(dealt, "ranges").withColumn(part, F.shiftright(at, _ROW_BITS)).withColumn(index, F.col(at).bitwiseAND((1 << _ROW_BITS) - 1))
    running = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    before = dealt.groupBy(part).agg(F.count(F.lit(1)).alias(rows)).select(part, F.coalesce(F.sum(rows).over(running), F.lit(0)).alias(ahead))
    if not ks:
        numbered = dealt.join(F.broadcast(before), part)
        return numbered.select(*(F.col(f"`{c}`") for c in frame.columns), (F.col(ahead) + F.col(index) + 1).alias(name))
    in_range = dealt.groupBy(part, *ks).agg(F.min(index).alias(first)).join(F.broadcast(before), part).select(part, *ks, ahead, (F.col(first) + F.col(ahead)).alias(first))
    begins = in_range.withColumn(first, F.min(first).over(Window.partitionBy(*ks)))
    on = [F.col(f"a.{part}") == F.col(f"b.{part}"), *(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ks)]
    joined = dealt.alias("a").join(begins.alias("b"), on)
    return joined.select(*(F.col(f"a.`{c}`") for c in frame.columns), (F.col(f"b.{ahead}") + F.col(f"a.{index}") - F.col(f"b.{first}") + 1).alias(name))
