"""Document fingerprints by Order MinHash.

A text's k-mers are numbered by occurrence, so that repeats differ. For each of the sketch's slots, a seeded hash picks
the smallest few of these; they are put in text order and the tuple of their k-mers is hashed. Two texts agree in a slot
with a probability that falls with their edit distance, since both content and order must agree; likeness is the share of
equal slots. Equal texts have equal fingerprints.

A text shorter than k is one k-mer; one with fewer k-mers than a tuple uses all it has; the empty text's tuple is empty.

`neighbours` gives each row the text of the next row in descending id order without a global sort in one task: rows are dealt by
ranges between ids that occur, and the row at each range's border also goes to the range above it. Rows without id come
last; equal ids are ordered by text; after the last row comes the first. Null text counts as empty. Rows that repeat are
each their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, TUPLE, SLOTS = 8, 2, 24
_U = np.uint64
#: Odd multipliers for hashing, from the golden ratio and a seeded generator.
GOLDEN = _U(0x9E3779B97F4A7C15)
SEEDS = np.random.default_rng(4).integers(0, 2**63, 1024, dtype="u8") * _U(2) + _U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> _U(32))) * GOLDEN
    x = (x ^ (x >> _U(29))) * SEEDS[-1]
    return x ^ (x >> _U(32))


def kmers(text: str, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of code points, in text order."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8")
    k = min(k, len(points))
    if not k:
        return np.zeros(0, "u8")
    out = np.zeros(len(points) - k + 1, "u8")
    for i in range(k):
        out = out * GOLDEN + points[i : i + len(out)]
    return mixed(out + _U(k))


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, how many equal ones came before), in text order."""
    n = len(hashes)
    bits = _U(max(1, n.bit_length()))
    order = np.sort(((hashes >> bits) << bits) | np.arange(n, dtype="u8"))
    where, group = order & ((_U(1) << bits) - _U(1)), order >> bits
    at = np.arange(n)
    starts = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), at, 0))
    earlier = np.empty(n, "u8")
    earlier[where] = at - starts
    return mixed(hashes + earlier * SEEDS[-2]) if (at != starts).any() else mixed(hashes)


def fingerprint(text: str, k: int = K, tuple_size: int = TUPLE, slots: int = SLOTS) -> np.ndarray:
    """One 32-bit number for each slot."""
    hashes = kmers(text, k)
    if not len(hashes):
        return np.zeros(slots, "u4")
    keys, out = numbered(hashes), np.empty(slots, "u8")
    take = min(tuple_size, len(keys))
    for s in range(slots):
        ranks = keys * SEEDS[s]
        ranks ^= ranks >> _U(31)
        best = [int(ranks.argmin())]
        while len(best) < take:
            ranks[best[-1]] = np.iinfo("u8").max
            best.append(int(ranks.argmin()))
        value = 0
        for at in sorted(best):
            value = (value * 0x9E3779B97F4A7C15 + int(hashes[at]) + 1) % 2**64
        out[s] = value
    return (mixed(out) >> _U(32)).astype("u4")


def as_text(print_: np.ndarray) -> str:
    return print_.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of slots in which two fingerprints agree."""
    return float((a == b).mean())


def neighbours(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(part, halo, doc_id, text), dealt by part and sorted: within a part, the rows in descending id order, then one or
    more rows with `halo` set, the first of which follows the part's last row."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = source.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [1.0], max(10_000, 20 * n)).alias("c"), F.max("doc_id").alias("m")).first()
    edges, top = sorted(set(cuts.c or [])), cuts.m
    edges = [e for e in edges if e != top]  # a part holds the ids above the edge before it, up to its own edge

    @F.pandas_udf("array<int>")
    def parts(ids: pd.Series) -> pd.Series:
        found = np.searchsorted(np.array(edges, "i8"), ids.fillna(np.iinfo("i8").min).to_numpy("i8", copy=True))
        halo = ids.isin(edges).to_numpy()
        return pd.Series([[p, p + 1] if h else [p, 0] if i == top else [p] for p, h, i in zip(found.tolist(), halo, ids, strict=True)])

    dealt = source.select(F.posexplode(parts("doc_id")).alias("halo", "part"), "doc_id", "text")
    return dealt.select("part", "halo", "doc_id", "text").repartitionById(n, F.col("part")).sortWithinPartitions("part", "halo", F.col("doc_id").desc_nulls_last(), "text")


def edited_text(text: str, following: str) -> str:
    """The last half of the characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edit_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first = last = None  # of the part: (id, text, fingerprint)
        part, done = None, False

        def report(row, after) -> None:
            edited = edited_text(row[1], after[1])
            print_ = fingerprint(edited)
            out.append((row[0], len(row[1]), hashlib.sha256(edited.encode()).hexdigest(), as_text(row[2]), as_text(print_), likeness(row[2], print_), likeness(row[2], after[2])))

        def block() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.record_batch(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            id_type = batch.schema.field(2).type
            for p, halo, i, t in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                if p != part:
                    if last is not None and not done:
                        report(last, first)
                    part, first, last, done = p, None, None, False
                if halo and (done or last is None):
                    continue
                row = (i, t.as_py(), None)
                row = (*row[:2], fingerprint(row[1]))
                if last is not None:
                    report(last, row)
                if halo:
                    done = True
                else:
                    first, last = first or row, row
                if len(out) >= 1000:
                    yield block()
        if last is not None and not done:
            report(last, first)
        if out:
            yield block()

    source = neighbours(docs, text, doc_id)
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(rows, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
