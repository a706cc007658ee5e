"""Typed sources: rows in memory, Parquet, JSON lines, concatenated JSON, and folders as streams."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.sources.staging import fresh_path


def from_rows(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """An in-memory relation that can be read any number of times."""
    return spark.createDataFrame(list(rows), schema)


def from_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def rows_of(frame: DataFrame) -> Iterator[T.Row]:
    """Rows to the driver, one partition at a time."""
    return frame.toLocalIterator()


def _strict(frame: DataFrame, schema: T.StructType, required: bool) -> DataFrame:
    """Fails on rows whose required fields are missing: Spark alone gives null for them."""
    if not required:
        return frame
    for field in schema.fields:
        if not field.nullable:
            missing = F.raise_error(F.lit(f"missing field {field.name}"))
            frame = frame.withColumn(field.name, F.coalesce(F.col(field.name), missing.cast(field.dataType)))
    return frame


def from_ndjson(spark: SparkSession, path: str, schema: T.StructType, required: bool = True) -> DataFrame:
    """One JSON value a line. Malformed values and missing non-nullable fields raise; extra fields are ignored."""
    return _strict(spark.read.schema(schema).option("mode", "FAILFAST").json(path), schema, required)


def split_json(text: str) -> Iterator[str]:
    """The JSON values of a text, wherever they end; an incomplete tail raises."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at == len(text):
            return
        _, end = decoder.raw_decode(text, at)
        yield text[at:end]
        at = end


#: A file of concatenated JSON is read whole by one task, so it has to fit there several times.
CONCAT_LIMIT = 256 << 20


def from_concat_json(spark: SparkSession, path: str, schema: T.StructType, required: bool = True, max_file_bytes: int = CONCAT_LIMIT) -> DataFrame:
    """JSON values one after another, on one line or over several. Values can end anywhere, so a file is one task's work; a file of
    over `max_file_bytes` raises before any is read. JSON lines is the way for large files."""
    large = spark.read.format("binaryFile").load(path).select("path", "length").where(F.col("length") > max_file_bytes).orderBy(F.col("length").desc()).first()
    if large:
        raise ValueError(f"{large.path} has {large.length} bytes; concatenated JSON is read whole, and the limit is {max_file_bytes}")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                block: list[str] = []
                for value in split_json(text):
                    block.append(value)
                    if len(block) == 10_000:
                        yield pa.record_batch([pa.array(block, pa.string())], names=["value"])
                        block = []
                if block:
                    yield pa.record_batch([pa.array(block, pa.string())], names=["value"])

    lines = spark.read.text(path, wholetext=True).select("value").mapInArrow(values, "value string")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v")).select("v.*")
    return _strict(parsed, schema, required)


def stage_as_stream_source(frame: DataFrame, files: int = 3) -> str:
    """Writes a frame as several files to its own folder, for a file stream to pick up one at a time."""
    path = fresh_path(frame.sparkSession, "stream-source")
    frame.repartition(files).write.parquet(path)
    return path


def stream_from_dir(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = 1) -> DataFrame:
    """A folder of Parquet files as a stream; `files_per_trigger` throttles it."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
