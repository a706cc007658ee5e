"""Mixing to target weights with soft memberships.

A classifier fitted on the labelled table gives each document posteriors p over domains. Each document d of n tokens (words
between white space) gets a rate r, the expected number of its copies in the mixture. Rates minimize the squared relative
difference between the expected totals of the domains, A r with A[k, d] = n[d] p[d, k], and the targets, by projected gradient:

    r[d] <- max(least, s[d] - p[d] . h)   with h = step * W (A s - T), W = diag(1 / M[k, k]), M = A p

in the geometry that weighs documents by their tokens, in which the step is the inverse of the largest eigenvalue of W M, from s, the
rates r carried on a little in the direction of the round before (accelerated; not where that is uphill). First come rounds with the
inverse of M as W, which meet targets within reach in few rounds however much the domains overlap; where those do not
come nearer, the rounds above follow, from the start. A round is one job that sums one number more than there are domains; rates are replayed from
the h and momenta of all rounds, so nothing but these is kept. A fit that runs out of rounds warns of what is left.

The classifier is a naive Bayes over hashed words and word shapes, with counts from at most `SAMPLE` labelled rows, those with the
smallest hashed ids; its evidence counts as that of `EVIDENCE` words at most, so memberships stay soft. All else covers all rows.

Cases: null and empty texts have no tokens, the prior's posteriors and their rate moves no total; without labelled rows
there is one domain, named `all`; a domain without a target has target 0, and a target without a domain cannot be met. Rows that repeat
are documents of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.cache import Memo, alone, small_batches
from tributary.llm.folds import labelled_sample
from tributary.llm.toxicity import PUNCTUATION
from tributary.sources.staging import staged

SAMPLE, EVIDENCE = 40_000, 64
WORD_BITS, SHAPE_BITS = 14, 12
#: Rounds at most, of them those in which the gap has to halve while targets seem within reach, and how far off a total may be.
ROUNDS, TRIED, TOLERANCE = 400, 5, 1e-4


def shape(word: str) -> str:
    """Letters as X or x, digits as 9, repeats once."""
    out = ""
    for c in word:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if out[-1:] != kind:
            out += kind
    return out


def _feature(word: str) -> int:
    """Hashes of the bare word and of the shape in one number."""
    bare = word.strip(PUNCTUATION).lower()
    return (xxhash.xxh32_intdigest(bare) >> (32 - WORD_BITS)) << SHAPE_BITS | xxhash.xxh32_intdigest(shape(word)) >> (32 - SHAPE_BITS)


class Features:
    """Feature numbers of texts, with a memo."""

    def __init__(self) -> None:
        self.memo = Memo(_feature, 180_000)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        return np.fromiter(map(self.memo.__getitem__, words), "i8", len(words))


def _features() -> Features:
    """One for each worker process."""
    return alone(("features",), Features)


@dataclass
class Classifier:
    """Log probabilities of words and shapes relative to all domains', and the domains' priors."""

    domains: list[str]
    prior: np.ndarray
    words: np.ndarray
    shapes: np.ndarray

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior)
        if len(features):
            total = self.words[features >> SHAPE_BITS].sum(axis=0) + self.shapes[features & ((1 << SHAPE_BITS) - 1)].sum(axis=0)
            logs = logs + total * min(1, EVIDENCE / len(features))
        p = np.exp(logs - logs.max())
        return p / p.sum()


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: Column, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Classifier:
    """Learns the domains that `domain` gives for rows of `labels`; the smallest name counts where an id has several."""
    small_batches(docs.sparkSession)
    train = staged(labelled_sample(docs, labels, domain, text, doc_id, sample), "mixing-sample")
    names = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains = sorted(names)
    if not domains:
        return Classifier(["all"], np.ones(1), np.zeros((1 << WORD_BITS, 1)), np.zeros((1 << SHAPE_BITS, 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _features()
        words, shapes = np.zeros((len(domains), 1 << WORD_BITS), "i8"), np.zeros((len(domains), 1 << SHAPE_BITS), "i8")
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                f, k = features(t.as_py()), domains.index(y)
                words[k] += np.bincount(f >> SHAPE_BITS, minlength=1 << WORD_BITS)
                shapes[k] += np.bincount(f & ((1 << SHAPE_BITS) - 1), minlength=1 << SHAPE_BITS)
        for table, kind in ((words, 0), (shapes, 1)):
            k, at = table.nonzero()
            yield pa.record_batch([pa.array([kind] * len(k), pa.int32()), pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.array(table[k, at])], names=["kind", "k", "at", "n"])

    sums = train.select("text", "y").mapInArrow(count, "kind int, k int, at int, n bigint").groupBy("kind", "k", "at").agg(F.sum("n").alias("n")).toPandas()  # at most domains * (words + shapes) rows

    def table(kind: int, size: int) -> np.ndarray:
        out = np.full((size, len(domains)), 0.5)
        rows = sums[sums.kind == kind]
        out[rows["at"], rows["k"]] += rows["n"]
        out /= out.sum(axis=0)
        return np.log(out) - np.log(out.mean(axis=1, keepdims=True))

    n = np.array([names[d] for d in domains], "f8")
    return Classifier(domains, n / n.sum(), table(0, 1 << WORD_BITS), table(1, 1 << SHAPE_BITS))


@dataclass
class Mixture:
    """A fitted mixture: the classifier and the steps from which any document's rate follows."""

    classifier: Classifier
    steps: np.ndarray
    least: float
    totals: np.ndarray
    targets: np.ndarray

    def rates(self, p: np.ndarray) -> np.ndarray:
        return replayed(p, self.steps, self.least)


def replayed(p: np.ndarray, steps: np.ndarray, least: float) -> np.ndarray:
    """Rates of documents with posteriors p (a row each) after these steps: h, and last the momentum with which its round began."""
    return _last_move(p, steps, least)[0]


def _last_move(p: np.ndarray, steps: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates, and how far the last round moved them from where it began."""
    before = start = r = np.ones(len(p))
    for *h, momentum in steps:
        start = r + momentum * (r - before)
        before, r = r, np.maximum(least, start - p @ np.array(h))
    return r, r - start


def memberships(docs: DataFrame, classifier: Classifier, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, posterior) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _features()
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([classifier.posteriors(f).tolist() for f in found], pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "posterior"])

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, posterior array<double>")


def _sums(members: DataFrame, columns: int, of) -> np.ndarray:
    """Sums over all documents of an array of numbers; `of` gives a block's sums from its tokens and posteriors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(columns)
        for batch in batches:
            if batch.num_rows:
                p = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                total += of(batch.column(0).to_numpy().astype("f8"), p).ravel()
        yield pa.record_batch([pa.array(np.arange(columns), pa.int32()), pa.array(total)], names=["k", "v"])

    out = np.zeros(columns)
    for row in members.select("n_tokens", "posterior").mapInArrow(rows, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[row.k] = row.v
    return out


def fit_mixture(members: DataFrame, classifier: Classifier, weights: dict[str, float], total: float | None = None, least: float = 0.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Mixture:
    """Fits rates to targets, which are `weights` (made to sum to one) of `total` tokens.

    By default the total is that of all documents. ``total=math.inf`` takes the least total at which no weighted domain has
    to shrink. Stops when no domain with a target is off by more than `tolerance` of it or a round moves rates by no
    more than that on average, weighted by tokens; warns if neither comes within `rounds`.
    """
    k = len(classifier.domains)
    m = _sums(members, k * k, lambda n, p: (p * n[:, None]).T @ p).reshape(k, k)
    natural = m.sum(axis=1)
    w = np.array([max(0.0, weights.get(d, 0.0)) for d in classifier.domains])
    w = w / w.sum() if w.sum() else np.full(k, 1 / k)
    if total is None:
        total = natural.sum()
    elif np.isinf(total):
        total = max((a / b for a, b in zip(natural, w, strict=True) if b), default=0.0)
    targets = w * total
    scale = 1 / np.maximum(np.diag(m), 1e-12)
    largest = np.linalg.eigvals(scale[:, None] * m).real.max() if natural.sum() else 1.0
    inverse, plain = np.linalg.pinv(m, rcond=1e-12, hermitian=True), np.diag(scale / largest)
    metric, age, gaps = inverse, 1.0, [np.inf]
    steps, reached, earlier = np.zeros((0, k + 1)), natural, natural
    met = lambda: (np.abs(reached - targets) <= tolerance * np.maximum(targets, tolerance * total)).all()
    at_rest = not natural.sum()
    while not at_rest and not met() and len(steps) < rounds:
        older, age = age, (1 + np.sqrt(1 + 4 * age * age)) / 2
        momentum = (older - 1) / age
        off = reached + momentum * (reached - earlier) - targets
        steps = np.vstack([steps, [*(metric @ off), momentum]])

        def summed(n: np.ndarray, p: np.ndarray, steps: np.ndarray = steps) -> np.ndarray:
            r, moved = _last_move(p, steps, least)
            return np.append((p * (n * r)[:, None]).sum(axis=0), (n * np.abs(moved)).sum())

        *now, moved = _sums(members, k + 1, summed)
        earlier, reached = reached, np.array(now)
        if off @ metric @ (reached - earlier) > 0:
            age = 1.0
        gaps.append(np.abs(reached - targets).max())
        slow = len(gaps) > TRIED and min(gaps[-TRIED:]) > min(gaps[:-TRIED]) / 2
        if metric is plain:
            at_rest = moved <= tolerance * natural.sum()
        elif slow and not met():
            metric, age, steps, reached, earlier = plain, 1.0, np.zeros((0, k + 1)), natural, natural
    if not at_rest and not met():
        warnings.warn(f"mixing: after {rounds} rounds the totals of {classifier.domains} are off by {(reached - targets).tolist()} tokens", stacklevel=2)
    return Mixture(classifier, steps, least, reached, targets)


def copies(rate: Column, doc_id: Column, seed: int = 7) -> Column:
    """A whole number of copies whose expectation is the rate: rounded up where the id's hash, as a fraction, allows."""
    fraction = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / float(2**53)
    return F.floor(rate + fraction).cast("int")


def mix_report(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, rate, copies, posterior) of each row; posterior: by domain, in the order of their names."""
    classifier = fit_classifier(docs, labels, domain, text, doc_id)
    members = staged(memberships(docs, classifier, text, doc_id), "memberships")
    mixture = fit_mixture(members, classifier, weights)

    @F.pandas_udf("double")
    def rate(posterior: pd.Series) -> pd.Series:
        return pd.Series(mixture.rates(np.stack(posterior.to_numpy())) if len(posterior) else [], dtype="f8")

    rated = members.withColumn("rate", rate("posterior"))
    return rated.select("doc_id", "n_tokens", "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"), "posterior")


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], text: str = "text", doc_id: str = "doc_id", **fit) -> DataFrame:
    """The mixture: rows of `docs`, each as often as its copies say."""
    classifier = fit_classifier(docs, labels, domain, text, doc_id)
    mixture = fit_mixture(staged(memberships(docs, classifier, text, doc_id), "memberships"), classifier, weights, **fit)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        features = _features()
        return pd.Series(mixture.rates(np.array([classifier.posteriors(features(t)) for t in texts]).reshape(len(texts), -1)), dtype="f8")

    rate = rate.asNondeterministic()  # else the filter and the projection each evaluate it, in a worker of its own
    n, at = f"copies_{uuid.uuid4().hex}", f"copy_{uuid.uuid4().hex}"  # names that no table has
    often = docs.withColumn(n, copies(rate(F.col(f"`{text}`")), F.col(f"`{doc_id}`"))).where(F.col(n) > 0)
    return often.withColumn(at, F.explode(F.sequence(F.lit(1), n))).drop(n, at)
