"""Folds by the CRC-32 of an id's decimal text, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32(id as text) mod `folds`; 0 for a row without id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0)).cast("int")


def smallest_hashes(frame: DataFrame, columns: list[str], rows: int, total: int) -> DataFrame:
    """The rows, at most `rows` of `total`, whose hashes of `columns` are smallest, whatever the order or number of files.
    Most rows are told by their hash alone, so that no task has to rank more than a few times `rows`."""
    hashed = F.xxhash64(*columns)
    if total > 8 * rows:
        frame = frame.where(hashed < -(2**63) + 2**64 * 4 * rows // total)
    return frame.orderBy(hashed, *columns).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, text: str, doc_id: str, rows: int) -> DataFrame:
    """(__id, text, y) of the labelled documents whose hashed ids are smallest, at most `rows` ids. An id with several
    labels has the smallest; null labels and ids are left out."""
    marked = labels.select(F.col(f"`{doc_id}`").alias("__id"), label.alias("y")).where("__id is not null and y is not null").groupBy("__id").agg(F.min("y").alias("y"))
    chosen = smallest_hashes(marked, ["__id"], rows, marked.count())  # bounded, so it can go to every task
    texts = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select("__id", "text", "y")
