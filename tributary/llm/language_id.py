"""Language identification with hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. An n-gram's vector binds its letters' vectors, each permuted (rolled) by its
place, by elementwise product. A text's profile bundles the vectors of all its trigrams by summing. A language's prototype is
the bundle of its training texts; the predicted language is the one whose prototype has the largest cosine with the text.

Bundling is linear, so training sums trigram counts by language, in all tasks, and binds each trigram once. Only one vector
for each language goes to the driver.

Cases: text that is null or has no letter gets `und` and score 0, as does every text if there is nothing to learn from. Rows
with null language are predicted but not learned from. Equal cosines go to the language that sorts first. Texts are read whole; rows
that repeat count each time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS, LETTERS, SEED = 1024, 64, 20_160
#: Documents whose profiles are made together, and the languages that a task counts before it hands on what it has.
BATCH, HELD = 128, 32


@functools.cache
def letter_codes() -> np.ndarray:
    """For each code point 0 if it is no letter, 1-26 for a-z in either case, else one of the places left."""
    codes = np.zeros(0x110000, "u1")
    for point in range(0x110000):
        char = chr(point)
        if unicodedata.category(char)[0] == "L":
            low = ord(char.lower()[0])
            codes[point] = low - 96 if 97 <= low <= 122 else 27 + low % (LETTERS - 27)
    return codes


@functools.cache
def letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors, rolled by two places, by one, and as they are."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], "i1"), (LETTERS, DIMENSIONS))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def bound(trigrams: np.ndarray) -> np.ndarray:
    """The vectors of trigrams given by number."""
    two, one, none = letter_vectors()
    return two[trigrams // LETTERS**2] * one[trigrams // LETTERS % LETTERS] * none[trigrams % LETTERS]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text, and how often each occurs; what lies between words is one blank."""
    if not text:
        return np.zeros(0, "i4"), np.zeros(0, "i8")
    codes = letter_codes()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    codes = np.concatenate([[0], codes, [0]]).astype("i4")
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    if len(codes) < 3:
        return np.zeros(0, "i4"), np.zeros(0, "i8")
    return np.unique(codes[:-2] * LETTERS**2 + codes[1:-1] * LETTERS + codes[2:], return_counts=True)


def profiles(texts: list[str | None]) -> np.ndarray:
    """The bundled vectors of some texts; zeros for those without letters."""
    found = [trigrams(t) for t in texts]
    grams, places = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    counts = np.zeros((len(texts), len(grams)), "f4")
    counts[np.repeat(np.arange(len(texts)), [len(g) for g, _ in found]), places] = np.concatenate([n for _, n in found])
    return counts @ bound(grams).astype("f4")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A prototype of length one for each language of `docs`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                at = counts.nonzero()[0]
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name not in held:
                    if len(held) >= HELD:
                        yield from rows()
                    held[name] = np.zeros(LETTERS**3, "i8")
                grams, n = trigrams(t.as_py())
                held[name][grams] += n
        yield from rows()

    def bundle(table: pa.Table) -> pa.Table:
        grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        total = np.zeros(DIMENSIONS)
        for at in range(0, len(grams), 4096):
            total += n[at : at + 4096].astype("f8") @ bound(grams[at : at + 4096]).astype("f8")
        size = np.linalg.norm(total)
        return pa.table({"lang": table.column("lang")[:1], "prototype": pa.array([(total / size if size else total).tolist()], pa.list_(pa.float64()))})

    counted = docs.where(F.col(lang).isNotNull()).select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).mapInArrow(count, "lang string, gram int, n bigint")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return {r.lang: np.array(r.prototype) for r in summed.groupBy("lang").applyInArrow(bundle, "lang string, prototype array<double>").collect()}


def predictor(prototypes: dict[str, np.ndarray]):
    """A function of a text column that gives a struct of `lang_pred` and `score`."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] for n in names], "f4").reshape(len(names), DIMENSIONS)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], []
        for at in range(0, len(texts), BATCH):
            part = [t if isinstance(t, str) else None for t in texts.iloc[at : at + BATCH]]
            vectors = profiles(part)
            sizes = np.linalg.norm(vectors, axis=1)
            near = vectors @ matrix.T / np.maximum(sizes, 1e-9)[:, None] if names else np.zeros((len(part), 1))
            best = near.argmax(axis=1)
            for k, t in enumerate(part):
                known = bool(names) and t is not None and bool(letter_codes()[np.frombuffer(t.encode("utf-32-le"), "<u4")].any())
                langs.append(names[best[k]] if known else "und")
                scores.append(float(np.clip(near[k, best[k]], 0, 1)) if known else 0.0)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def identify(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row, learned from the rows that are not held out."""
    predict = predictor(learn(docs.where(~held_out), text, lang))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out.alias("held_out"), predict(F.col(f"`{text}`")).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
