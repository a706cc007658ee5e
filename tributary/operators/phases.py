"""The early and late results of a progressive join, told apart by run numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tributary.functions.predicate import Predicate
from tributary.operators.batch import sort_merge


def early(left: DataFrame, right: DataFrame, pred: Predicate, left_run: str, right_run: str) -> DataFrame:
    """Pairs of rows that were in memory together: their runs are the same."""
    return sort_merge(left, right, pred.where(lambda l, r: l(left_run) == r(right_run)))


def ignoring_same_run(pred: Predicate, left_run: str, right_run: str) -> Predicate:
    """The predicate for merging stored runs: pairs of one run have met before."""
    return pred.where(lambda l, r: l(left_run) != r(right_run))


def late(left: DataFrame, right: DataFrame, pred: Predicate, left_run: str, right_run: str) -> DataFrame:
    """Pairs that meet only when stored runs are merged."""
    return sort_merge(left, right, ignoring_same_run(pred, left_run, right_run))
