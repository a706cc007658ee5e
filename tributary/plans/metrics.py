"""What a plan did: rows, exchanges, spill and predicate calls, from Spark's own counters."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.predicate import Predicate

#: Counters of Spark's plan nodes, and what they are called here.
COUNTERS = {"shuffleRecordsWritten": "rows_shuffled", "shuffleBytesWritten": "bytes_shuffled", "spillSize": "bytes_spilled"}


def _nodes(plan) -> Iterator:
    """All nodes of a physical plan, through the stages of an adaptive one; a reused exchange counts once."""
    yield plan
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    elif name != "ReusedExchangeExec":
        children = plan.children()
        for i in range(children.size()):
            yield from _nodes(children.apply(i))


def measure(frame: DataFrame) -> dict[str, int]:
    """Runs the frame's plan once, drops the rows, and gives rows_out, rows_shuffled, bytes_shuffled, bytes_spilled and the
    numbers of exchanges, broadcasts and sorts."""
    execution = frame._jdf.queryExecution()
    out = Counter(rows_out=execution.toRdd().count(), exchanges=0, broadcasts=0, sorts=0, **dict.fromkeys(COUNTERS.values(), 0))
    for node in _nodes(execution.executedPlan()):
        name = node.getClass().getSimpleName()
        out["exchanges"] += name == "ShuffleExchangeExec"
        out["broadcasts"] += name == "BroadcastExchangeExec"
        out["sorts"] += name == "SortExec"
        metrics = node.metrics().iterator()
        while metrics.hasNext():
            pair = metrics.next()
            if pair._1() in COUNTERS and name in ("ShuffleExchangeExec", "SortExec"):
                out[COUNTERS[pair._1()]] += max(0, pair._2().value())
    return dict(out)


def counted(spark: SparkSession, pred: Predicate) -> tuple[Predicate, Accumulator]:
    """The predicate, and a counter of the pairs that it was asked about: those that meet by key, or all for other conditions.
    For measurements; the check goes through Python. Tasks that run twice count twice."""
    calls = spark.sparkContext.accumulator(0)
    names = [f"calls_{uuid.uuid4().hex}" for _ in "lr"]  # columns of either side, so that no check moves below the join

    @F.pandas_udf("boolean")
    def passes(matched: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        calls.add(len(matched))
        return matched

    old = pred.condition

    def condition(l, r):  # noqa: E741
        terms = [old(l, r)] if old else [F.lit(True)]
        return passes(reduce(lambda x, y: x & y, terms), l(names[0]), r(names[1]))

    marks = [lambda f, n=n: f.withColumn(n, F.monotonically_increasing_id()) for n in names]
    maps = {"left_maps": (*pred.left_maps, marks[0]), "right_maps": (*pred.right_maps, marks[1]), "output": (lambda f: f.drop(*names), *pred.output)}
    return replace(pred, condition=condition, **maps), calls
