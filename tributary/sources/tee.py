"""One relation for several consumers, read once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tributary.sources.staging import fresh_path, staged


def tee(frame: DataFrame, name: str = "tee") -> tuple[DataFrame, DataFrame]:
    """(the frame to go on with, the record of all its rows); the source is read once, when this is called, and written."""
    kept = staged(frame, name)
    return kept, kept


def tee_stream(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]]) -> StreamingQuery:
    """Hands each micro-batch to every sink, a function of the batch and its number, and reads it once. Runs over the input there
    is. A micro-batch that failed comes again under its number."""

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    where = fresh_path(stream.sparkSession, "tee-state")
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", where).trigger(availableNow=True).start()
