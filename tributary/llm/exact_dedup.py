"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt to runs by id. A run is reduced to one entry for each digest, an identifier and a row count, and sorted by digest, slice
by slice. Then come binomial rounds: of each `fan_in` neighbouring runs the first receives the others' and merges them, all in
digest order, so equal digests meet as neighbours and become one entry, until one run is left. Runs and slices are
exchanged together, so no task holds a run, and a text that a third of all rows share is one entry of each run.

Every merge verifies what it retains: an entry's key is the text's SHA-256 with its byte length and an independent 64-bit hash, and
entries become one only if all three agree. With ``verify_texts`` the texts of groups are read again at the end, and each is compared,
byte by byte, with that of the identifier retained; a difference raises, so no text goes for another's sake. Going back down the tree, rows
meet their entry by (run, key), which splits a hot text over `runs` keys, each with its own copy of the retained text.

Cases: null text counts as empty, and empty texts are equal to each other. Case is folded for A-Z only. A row without id
never wins against one with an id; a group without any id has a null `keep_id` and keeps all its rows. Rows that repeat
an id and its text are one document: each counts in `group_size`, and all carry the same `kept`. An empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.sources.staging import discard, staged

#: Runs, those merged at a time, and bits of the digest that tell a run's slices.
RUNS, FAN_IN, SLICE_BITS = 64, 4, 12
KEY = ["digest", "n_bytes", "second"]
ORDER = ["run", "slice", *KEY]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", runs: int = RUNS) -> DataFrame:
    """(id, run, digest, n_bytes, second) of each row."""
    return _folded(docs, text, doc_id, runs).drop("t")


def _folded(docs: DataFrame, text: str, doc_id: str, runs: int) -> DataFrame:
    folded = docs.select(F.col(f"`{doc_id}`").alias("id"), ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("t"))
    return folded.select(
        "id",
        "t",
        F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run"),
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("second"),
    )


def merged(entries: DataFrame, fan_in: int, best) -> DataFrame:
    """One round: each `fan_in` neighbouring runs, sorted by slice and digest, become one. Runs meet by (run, slice); what a task reads are
    sorted pieces, which it merges, and equal neighbours are one entry. No other exchange or sort is needed for that."""
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = entries.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition(n, "run", "slice").sortWithinPartitions(*ORDER)
    return met.groupBy(*ORDER).agg(best("best").alias("best"), F.sum("n").alias("n"))


def tree(entries: DataFrame, runs: int, fan_in: int, best) -> DataFrame:
    """The one run that all rounds leave."""
    while runs > 1:
        runs = -(-runs // fan_in)
        entries = merged(entries, fan_in, best)
    return entries


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN, verify_texts: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row; of equal texts the row with the largest id stays, or
    the smallest with ``keep="min"``."""
    if fan_in < 2 or runs < 1:
        raise ValueError("fan_in must be 2 at least, runs 1")
    best, has_id = {"max": (F.max, F.col("id").isNotNull()), "min": (F.min, F.col("id").isNull())}[keep]
    rows = staged(digests(docs, text, doc_id, runs), "digests")
    leaves = rows.groupBy("run", *KEY).agg(best(F.struct(has_id, "id")).alias("best"), F.count(F.lit(1)).alias("n"))
    leaves = leaves.withColumn("slice", F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int").bitwiseAND((1 << SLICE_BITS) - 1))
    root = tree(leaves.select(*ORDER, "best", "n"), runs, fan_in, best).select(*KEY, F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))
    entries = staged(rows.select("run", *KEY).distinct().join(root.hint("merge"), KEY), "entries")
    if verify_texts:
        _verify(_folded(docs, text, doc_id, runs), entries)
    found = rows.join(entries.hint("merge"), ["run", *KEY])
    return found.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _verify(texts: DataFrame, entries: DataFrame) -> None:
    """Raises if a text differs from the retained one of its group."""
    several = entries.where("group_size > 1 and keep_id is not null").select("run", *KEY, "keep_id")
    met = staged(texts.join(F.broadcast(several) if several.count() <= VERIFY_ROWS else several.hint("merge"), ["run", *KEY]).select("run", *KEY, "id", "keep_id", "t"), "copies")
    retained = met.where("id = keep_id").groupBy(*KEY).agg(F.min("t").alias("retained"))
    spread = several.join(retained.hint("merge"), KEY)
    if met.join(spread.hint("merge"), ["run", *KEY]).where("t <> retained").limit(1).count():
        raise RuntimeError("texts of one digest, length and hash differ")
    discard(met)


#: Entries that may go to every task, and ids that may.
VERIFY_ROWS, BROADCAST_ROWS = 200_000, 2_000_000


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. What goes is a small part, and is sent to every task while it
    has few rows; else both sides are sorted and merged."""
    gone = staged(exact_dedup(docs, text, doc_id, **options).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).distinct(), "copies")
    sha = F.sha2(ascii_lower(F.coalesce(docs[text], F.lit(""))), 256)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["__id"]) & (sha == gone["__sha"]), "left_anti")
