"""Which partition to evict, given a frame of sizes ``(part, l, r)``; each policy returns one row of it.

The frame has a row for each partition, which is bounded by configuration and not by data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.names import free_names


def _total() -> Column:
    return F.col("l") + F.col("r")


def partition_stats(left: DataFrame, left_part: Column, right: DataFrame, right_part: Column) -> DataFrame:
    """Rows of each side in each partition."""
    ls = left.groupBy(left_part.alias("part")).agg(F.count(F.lit(1)).alias("l"))
    rs = right.groupBy(right_part.alias("part")).agg(F.count(F.lit(1)).alias("r"))
    return ls.join(rs, "part", "full").select(F.col("part").cast("int").alias("part"), F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("r", F.lit(0)).alias("r"))


def flush_smallest(stats: DataFrame) -> DataFrame:
    """The smallest partition that has rows; the first of equals."""
    return stats.where(_total() > 0).orderBy(_total(), "part").limit(1)


def flush_largest(stats: DataFrame) -> DataFrame:
    """The largest partition; the last of equals."""
    return stats.orderBy(_total().desc(), F.col("part").desc()).limit(1)


def _prefer(frame: DataFrame, flag: Column) -> DataFrame:
    """Rows with the flag, or all rows if none has it."""
    any_ = free_names(frame.columns, "any")[0]
    best = frame.agg(F.max(flag.cast("int")).alias(any_))
    return frame.crossJoin(F.broadcast(best)).where((F.col(any_) == 0) | flag).drop(any_)


def flush_adaptive(stats: DataFrame, a: int, b: float) -> DataFrame:
    """Keeps the two sides balanced.

    While |L / N - R / N| < b: prefers partitions with at least `a` rows on each side, then those whose removal leaves the
    ratio (over the old N) below b. Otherwise takes those heavy on the heavier side, and of them prefers at least `a` rows.
    Of what is left the largest, the last of equals. Each side's ratio is rounded to a 32-bit float before they are subtracted.
    """
    totals = stats.agg(F.sum("l").alias("tl"), F.sum("r").alias("tr"))
    share = lambda x: (x.cast("float") / (F.col("tl") + F.col("tr")).cast("float")).cast("float")  # noqa: E731  # Spark divides as doubles
    even = lambda x, y: F.abs((share(x) - share(y)).cast("float")) < F.lit(b).cast("float")
    flagged = stats.crossJoin(F.broadcast(totals)).select(
        "part", "l", "r",
        even(F.col("tl"), F.col("tr")).alias("balanced"),
        even(F.col("tl") - F.col("l"), F.col("tr") - F.col("r")).alias("keeps"),
        ((F.col("l") >= a) & (F.col("r") >= a)).alias("enough"),
        F.when(F.col("tl") >= F.col("tr"), F.col("l") >= F.col("r")).otherwise(F.col("r") >= F.col("l")).alias("heavy"),
    )
    left = _prefer(flagged.where(F.col("balanced") | F.col("heavy")), F.col("enough"))
    left = _prefer(left, ~F.col("balanced") | F.col("keeps"))
    return flush_largest(left.select("part", "l", "r"))


#: A policy maps a frame of (part, l, r), one row for each partition that holds rows, to one row of it; callers may pass their own.
POLICIES = {"smallest": flush_smallest, "largest": flush_largest, "adaptive": flush_adaptive}
