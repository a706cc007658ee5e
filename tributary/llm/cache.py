"""A bounded memo for functions of strings, and the one place of a worker for what is large."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession


class Memo(dict):
    """Keeps what was asked of late: two generations of `size` entries each. Keys over `longest` characters are not kept."""

    def __init__(self, function: Callable, size: int = 300_000, longest: int = 64):
        super().__init__()
        self.function, self.size, self.longest, self.older = function, size, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_held: list = [None, None]


def release() -> None:
    """Drops what `alone` keeps; operators without large caches call it first."""
    if _held[0] is not None:
        _held[:] = [None, None]
        gc.collect()
        pa.default_memory_pool().release_unused()


#: Rows of text in one Arrow batch.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand texts to Python a thousand rows at a time, where the session's setting is larger: the default of ten
    thousand holds some 100 MB of long texts in a task and again in its worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def alone(kind: tuple, make: Callable):
    """What `make` gives, kept in this process until another kind is asked for. Workers outlive stages; so a worker never
    holds the caches of two operators."""
    if _held[0] != kind:
        release()
        _held[:] = [kind, make()]
    return _held[1]
