"""Small documents tables with every odd case, for all operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeats, copies, near copies, shared passages, periodic and odd characters."""
    rng = random.Random(seed)
    texts = [None, "", " ", "\n\t ", "a", "A", "ÄÖ ñ", "one two", "One Two", "one two three four five", "<|endoftext|> it's <|startoftext|>x", "▁ x  y", "\x00\x1f\x85  b", "中文 😀 é", "İ ΑΣ ǅ ß"]
    base = words(rng, 120)
    texts += [base, base, base.upper()]
    for _ in range(25):  # near copies in a chain
        parts = base.split()
        for _ in range(rng.randrange(1, 4)):
            parts[rng.randrange(len(parts))] = f"x{rng.randrange(1000)}"
        base = " ".join(parts)
        texts.append(base)
    passage = words(rng, 110)
    texts += [words(rng, rng.randrange(5, 60)) + " " + passage + " " + words(rng, rng.randrange(5, 60)) for _ in range(12)]
    texts += ["ab" * 700, "a" * 900, words(rng, 30_000, 5000), passage[:399], passage[:400], passage[1:401]]
    texts += [words(rng, rng.randrange(1, 80)) for _ in range(40)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["hot", "hot", None, "s1"]), None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[9], out[20], out[20], (20, "another text of id twenty", "en", "s1", 25), (None, "a text without id", None, None, None), (None, base, None, None, None)]
    rng.shuffle(out)
    return out


#: Names that operators use for themselves, as columns of the input.
CLASHES = ["tid", "fp", "run", "digest", "n", "sid", "key", "kept", "score", "block", "__id", "__text", "__sha", "__gone", "__key", "__copy", "part", "halo", "id"]


def docs(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    frame = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
    return frame.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


def labels(spark: SparkSession, data: list[tuple]) -> DataFrame:
    return spark.createDataFrame(data, "doc_id bigint, quality int, toxic int")
