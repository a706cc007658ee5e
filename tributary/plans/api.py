"""One call for every strategy."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tributary.functions.predicate import Predicate
from tributary.operators import anti as anti_ops
from tributary.operators import batch
from tributary.sources.readers import from_rows
from tributary.streaming import phased, progressive

STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "nested_loop": batch.nested_loop,
    "block_nested_loop": batch.block_nested_loop,
    "ordered_merge": batch.ordered_merge,
    "sort_merge": batch.sort_merge,
    "simple_hash": batch.simple_hash,
    "anti": anti_ops.anti,
    "symmetric_hash": progressive.symmetric_hash,
    "progressive_merge": phased.progressive_merge,
    "xjoin": phased.xjoin,
    "hash_merge": phased.hash_merge,
}


def join(left: DataFrame, right: DataFrame, pred: Predicate, strategy: str = "sort_merge", **config) -> DataFrame:
    """Two frames under a predicate. `symmetric_hash` also combines two streams to a stream; `progressive_merge`, `xjoin` and `hash_merge`
    run over what two streams have, or two frames, and return what they wrote."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](left, right, pred, **config)


def join_in_memory(spark: SparkSession, left: Iterable, left_schema: T.StructType | str, right: Iterable, right_schema: T.StructType | str, pred: Predicate, strategy: str = "simple_hash", **config) -> DataFrame:
    """As join, on rows of the driver."""
    return join(from_rows(spark, left, left_schema), from_rows(spark, right, right_schema), pred, strategy, **config)
