"""Explicit runs: blocks of rows appended to shared storage, read again any number of times, and merged."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.sources.staging import delete_path, fresh_path


@dataclass
class RunStore:
    """Appends frames as numbered runs below one folder; the folder's partition column is ``run_id``.

    `rows_out` and `rows_in` count what was written and handed out to read.
    """

    spark: SparkSession
    path: str = ""
    runs: int = 0
    schemas: dict = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)
    rows_in: int = 0

    def __post_init__(self) -> None:
        self.path = self.path or fresh_path(self.spark, "runs")

    @property
    def rows_out(self) -> int:
        return sum(self.sizes.values())

    def store(self, frame: DataFrame, sort_by: list[str] | None = None) -> int:
        """Writes one run, each of its files sorted, and returns its number."""
        run = self.runs
        (frame.sortWithinPartitions(*sort_by) if sort_by else frame).write.parquet(self._at(run))
        self.schemas[run] = frame.schema
        self.runs += 1
        self.sizes[run] = self._read(run).count()
        return run

    def fetch(self, run: int) -> DataFrame:
        self.rows_in += self.sizes[run]
        return self._read(run)

    def rows(self, runs: Iterable[int]) -> DataFrame:
        """Runs of one schema as one frame, without their numbers."""
        wanted = list(runs)
        self.rows_in += sum(self.sizes[r] for r in wanted)
        return self.spark.read.schema(self.schemas[wanted[0]]).parquet(*map(self._at, wanted))

    def fetch_all(self, runs: Iterable[int] | None = None) -> DataFrame:
        """Some or all runs with their ``run_id``."""
        wanted = list(range(self.runs) if runs is None else runs)
        self.rows_in += sum(self.sizes[r] for r in wanted)
        frame = self.spark.read.option("basePath", self.path).parquet(*map(self._at, wanted))
        return frame.withColumn("run_id", F.col("run_id").cast("int"))

    def merged(self, by: list[str], runs: Iterable[int] | None = None) -> DataFrame:
        """Runs merged into one order: rows with their ``run_id``, dealt by ranges of `by` and sorted in each, so that reading the
        partitions one after another is the merge. Hot keys spread, since ``run_id`` comes last in the order."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = [*by, "run_id"]
        return self.fetch_all(runs).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def compact(self, by: list[str], runs: list[int]) -> int:
        """Replaces runs by one run in the order of `by` and returns its number."""
        fresh = self.store(self.merged(by, runs).drop("run_id"))
        self.delete(runs)
        return fresh

    def delete(self, runs: Iterable[int]) -> None:
        for run in runs:
            delete_path(self.spark, self._at(run))

    def _at(self, run: int) -> str:
        return f"{self.path}/run_id={run}"

    def _read(self, run: int) -> DataFrame:
        return self.spark.read.schema(self.schemas[run]).parquet(self._at(run))
