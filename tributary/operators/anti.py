"""Left anti combinations: by set, by bag, and by bag within blocks of left rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.functions.names import free_names
from tributary.functions.predicate import Predicate
from tributary.operators.ranking import row_numbers

#: Rows that one task may sort; groups above it are numbered by ranges, and so is a whole table above it.
HOT_ROWS = 1_000_000


def anti(left: DataFrame, right: DataFrame, pred: Predicate, mode: str = "set", block_rows: int | None = None, order_by: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left rows without a match.

    ``mode="set"``: NOT EXISTS. ``mode="bag"``: each right row removes one left row of its key; of n left rows in
    `order_by` order and c right rows, those numbered 2 to n - c + 1 stay, or all if c is 0. With `block_rows`, the
    left side is cut into blocks of that many rows in `order_by` order and each block meets the whole right side.
    Null keys match nothing unless the predicate is null-safe. Only groups of over `hot_rows` rows are written out to be numbered.
    """
    b = pred.bind(left, right, anti=True)
    if mode == "set":
        return b.first.join(b.second, b.condition, "left_anti")
    if mode != "bag":
        raise ValueError(f"unknown mode {mode!r}")
    if not pred.has_keys or pred.condition is not None or pred.swapped:
        raise ValueError("bag mode needs plain equality keys")
    if not order_by:
        raise ValueError("bag mode needs order_by: frames have no arrival order")
    if block_rows is not None and block_rows <= 0:
        raise ValueError("block_rows must be positive")
    columns = b.first.columns
    block, at, number, rows_, hit, *keys = free_names(columns, "block", "at", "number", "rows", "hits", *(f"key{i}" for i in range(len(b.keys))))
    order = [F.col(f"`{c}`") for c in order_by]
    rows = b.first.select("*", *(k.alias(a) for (k, _), a in zip(b.keys, keys, strict=True)))
    if block_rows is None:
        rows = rows.withColumn(block, F.lit(0).cast("bigint"))
    else:
        if rows.count() > hot_rows:
            rows = row_numbers(rows, [], order, at)
        else:
            rows = rows.withColumn(at, F.row_number().over(Window.orderBy(*order)))
        rows = rows.withColumn(block, F.floor((F.col(at) - 1) / block_rows).cast("bigint")).drop(at)
    group = [block, *keys]
    hits = b.second.groupBy(*(k.alias(a) for (_, k), a in zip(b.keys, keys, strict=True))).agg(F.count(F.lit(1)).alias(hit))
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias(rows_))
    same = lambda x, y, names: reduce(lambda p, q: p & q, [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) if pred.null_safe or k == block else F.col(f"{x}.{k}") == F.col(f"{y}.{k}") for k in names])

    def survivors(numbered: DataFrame) -> DataFrame:
        """Of rows with their number and their group's size, those that stay."""
        met = numbered.alias("a").join(hits.alias("b"), same("a", "b", keys), "left")
        stays = F.col(hit).isNull() | ((F.col(number) >= 2) & (F.col(number) <= F.col(rows_) - F.col(hit) + 1))
        return met.where(stays).select(*(F.col(f"a.`{c}`") for c in columns))

    def in_one_task(some: DataFrame) -> DataFrame:
        """Numbers and sizes from one exchange; groups are small."""
        window = Window.partitionBy(*group)
        return some.withColumn(number, F.row_number().over(window.orderBy(*order))).withColumn(rows_, F.count(F.lit(1)).over(window))

    largest = None if block_rows is not None and block_rows <= hot_rows else sizes.agg(F.max(rows_).alias("n")).first().n
    if (largest or 0) <= hot_rows:
        return survivors(in_one_task(rows))
    crowds = sizes.where(F.col(rows_) > hot_rows)
    held = F.col("a.`%s`" % block).eqNullSafe(F.col("c.`%s`" % block)) & reduce(lambda p, q: p & q, [F.col(f"a.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    few = rows.alias("a").join(crowds.alias("c"), held, "left_anti")
    many = rows.alias("a").join(crowds.alias("c"), held, "left_semi")
    many = row_numbers(many, [F.col(g) for g in group], order, number)
    many = many.alias("a").join(crowds.alias("c"), held).select("a.*", F.col(f"c.{rows_}"))
    return survivors(in_one_task(few)).union(survivors(many))
