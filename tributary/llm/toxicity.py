"""Toxicity: a learned lexicon matched through edits, and windows of context around each match.

The lexicon holds the terms that occur in toxic training texts far more often than chance allows, where near copies (about half of
the five-word shingles in common, by sketches) count as one text. Its trie is
intersected with the Levenshtein automata of its terms (no edit for short terms, one or two for longer ones); the product
is made deterministic state by state as texts need it, so a word costs one table look-up for each letter and most words
die after a few. Forms near a term that clean training texts use are not taken for misspellings.

Each match looks at the words around it: enclosing quotation marks, or a word of mention or report before it, make it a
quotation; a word that addresses the reader makes it abuse. The counts of exact, misspelled, quoted and addressed matches
and their density are weighted by a logistic regression. Labels, lang, source and doc_id are no inputs of a score.

Fitted on at most `SAMPLE` labelled rows, those with the smallest hashed ids; everything else covers all rows. Cases: null and empty
texts have no matches and get the score of such texts; a document labelled more than once is toxic if any label says so;
without labelled rows every score is 0; texts are read whole; rows that repeat are scored each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.cache import Memo, alone, release, small_batches
from tributary.llm.folds import labelled_sample
from tributary.llm.ngram_join import set_id, shingles
from tributary.llm.order_minhash import SEEDS
from tributary.sources.staging import staged

#: Labelled rows fitted on, terms kept (those least likely by chance), how unlikely a term's share of toxic texts must be by chance,
#: the least number of toxic texts that have it, and how many times likelier it is in a toxic text than in a clean one. Texts and their
#: near copies count as one in all three.
SAMPLE, TERMS, CHANCE, LEAST, LIKELIER = 40_000, 20_000, 1e-6, 3, 2
#: Minimum hashes of a text's shingles, those in a band, and how many of them near copies share.
SKETCH, BAND, ALIKE = 16, 2, 8
WINDOW = 6
PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»„“”‚‘’…–—¿¡"
OPENING, CLOSING = "\"“„«‘'>", "\"”“»’'"
#: Words that mention or report speech, and words that address the reader, in the corpus's languages.
MENTION = frozenset("said says wrote writes called quote quoted quoting word term phrase slur insult insulting sagte schrieb nannte zitat zitiert wort begriff dit écrit appelé citation mot terme dijo escribió llamó cita palabra término".split())
ADDRESS = frozenset("you your you're u ur yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted vosotros".split())
FEATURES = 6


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The product of a trie and the Levenshtein automata of its terms, made deterministic as it is used.

    A state is a set of (trie node, edits so far). A node knows the most edits that any term below it allows, so states that
    no term can accept are dropped at once.
    """

    MOST_STATES = 100_000

    def __init__(self, terms: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room = [0]
        for term in sorted(set(terms)):
            at, room = 0, allowed_edits(term)
            self.room[0] = max(self.room[0], room)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.room.append(0)
                at = self.children[at][c]
                self.room[at] = max(self.room[at], room)
            self.term[at] = term
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The number of the state of these nodes and their edits, with what skipping letters of terms reaches; -1 if empty."""
        todo = list(least)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                edits = least[node] + 1
                if edits <= self.room[child] and edits < least.get(child, 99):
                    least[child] = edits
                    todo.append(child)
        if not least:
            return -1
        members = frozenset(least.items())
        number = self.states.get(members)
        if number is None:
            number = self.states[members] = len(self.members)
            self.members.append(members)
            self.moves.append({})
        return number

    def _move(self, state: int, c: str) -> int:
        least: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.room[node] and edits < least.get(node, 99):
                least[node] = edits

        for node, edits in self.members[state]:
            reach(node, edits + 1)  # c is one too many
            for letter, child in self.children[node].items():
                reach(child, edits + (letter != c))
        to = self.moves[state][c] = self._state(least)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its allowed edits and the edits, the first of equally near ones; or nothing."""
        if len(self.members) > self.MOST_STATES:
            self._forget()
        state, moves = self.start, self.moves
        for c in word:
            to = moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return None
        found = [(edits, self.term[node]) for node, edits in self.members[state] if self.term[node] and edits <= allowed_edits(self.term[node])]
        return (lambda best: (best[1], best[0]))(min(found)) if found else None


@dataclass
class Model:
    """What a score needs: terms with their weights, forms that are no misspellings, and the regression."""

    terms: dict[str, float]
    clean_forms: frozenset[str]
    weights: np.ndarray
    prior: float = 0.0

    def __post_init__(self) -> None:
        self._ready()

    def _ready(self) -> None:
        content = hashlib.sha256(repr((sorted(self.terms.items()), sorted(self.clean_forms))).encode()).digest()
        self.automaton, self.words = alone(("toxicity", content), lambda: (LexiconAutomaton(self.terms), Memo(self._look, 120_000)))

    def __getstate__(self) -> tuple:
        return self.terms, self.clean_forms, self.weights, self.prior

    def __setstate__(self, state: tuple) -> None:
        self.terms, self.clean_forms, self.weights, self.prior = state
        self._ready()

    def _look(self, raw: str):
        """0, or (weight, edits, quotation mark before, quotation mark after) of a word as it stands in a text."""
        word = raw.strip(PUNCTUATION)
        hit = self.automaton.match(word) if word else None
        if not hit or (hit[1] and word in self.clean_forms):
            return 0
        lead, tail = raw[: raw.index(word)], raw[raw.index(word) + len(word) :]
        return self.terms[hit[0]], hit[1], any(c in OPENING for c in lead), any(c in CLOSING for c in tail)

    def features(self, text: str | None) -> np.ndarray:
        """Sums of weights of exact, misspelled, quoted and addressed matches, their density, and whether there is one."""
        out = np.zeros(FEATURES)
        words = (text or "").lower().split()
        hits = [(i, h) for i, h in enumerate(map(self.words.__getitem__, words)) if h]
        for i, (weight, edits, opens, closes) in hits:
            before = words[max(0, i - WINDOW) : i]
            after = words[i + 1 : i + 1 + WINDOW]
            opened = opens or sum(w[0] in OPENING for w in before) > sum(w[-1] in CLOSING for w in before)
            closed = closes or any(w[-1] in CLOSING for w in after)
            plain = {w.strip(PUNCTUATION) for w in before}
            if (opened and closed) or plain & MENTION:
                out[2] += weight
                continue
            out[1 if edits else 0] += weight
            if plain & ADDRESS or {w.strip(PUNCTUATION) for w in after} & ADDRESS:
                out[3] += weight
        out[4] = 100 * (out[0] + out[1]) / max(len(words), 20)
        out[5] = float(out[0] + out[1] > 0)
        out[:5] = np.log1p(out[:5])
        return out

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return self.prior
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + self.features(text) @ self.weights[1:])))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, the constant first and not shrunk."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, shrink = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    shrink[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chance_log10(toxic: Column, clean: Column, share: float) -> Column:
    """An upper bound of the log10 of the chance that a term of these many texts has so many toxic ones (Chernoff)."""
    n = toxic + clean
    q = F.least(F.greatest(toxic / n, F.lit(1e-12)), F.lit(1 - 1e-12))
    divergence = q * F.log(q / share) + (1 - q) * F.log((1 - q) / (1 - share))
    return F.when(q > share, -n * divergence / math.log(10)).otherwise(0.0)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The minimum hashes of a set of shingles."""
    return (hashes[:, None] * SEEDS[:SKETCH]).min(axis=0) if len(hashes) else np.zeros(SKETCH, "u8")


def near_copies(sketches: np.ndarray) -> np.ndarray:
    """A group's number for each row: rows that share a band with the first that has it, and `ALIKE` minimum hashes, are of one group."""
    group = list(range(len(sketches)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    for at in range(0, SKETCH, BAND):
        _, first, band = np.unique(sketches[:, at : at + BAND], axis=0, return_index=True, return_inverse=True)
        leader = first[band.ravel()]
        for i in np.flatnonzero((leader != np.arange(len(leader))) & ((sketches == sketches[leader]).sum(axis=1) >= ALIKE)).tolist():
            group[root(i)] = root(int(leader[i]))
    return np.array([root(i) for i in range(len(group))], "i8")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from `labels` rows joined with their documents; the caller leaves out what is held out."""
    small_batches(docs.sparkSession)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(0)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], names=["text", "y", "sid", "sketch"])

    sample_rows = labelled_sample(docs, labels, -F.col(label).cast("int"), text, doc_id, sample).select("text", (-F.col("y")).alias("y"))
    train = staged(sample_rows.mapInArrow(sketched, "text string, y int, sid bigint, sketch binary"), "toxicity-sample")
    texts = train.groupBy("sid", "y").agg(F.count(F.lit(1)).alias("n"), F.first("sketch").alias("sketch")).toPandas()  # at most a row for each sampled text
    n, t = int(texts.n.sum()), int(texts.n[texts.y == 1].sum())
    if not n or not t or t == n:
        return Model({}, frozenset(), np.zeros(0), float(t / n) if n else 0.0)
    texts["g"] = near_copies(np.frombuffer(b"".join(texts.sketch), "u8").reshape(-1, SKETCH))
    toxic, clean = (texts.g[texts.y == y].nunique() for y in (1, 0))
    share = toxic / (toxic + clean)
    several = texts[texts.g.map(texts.groupby("g").n.sum()) > 1]
    group = dict(zip(several.sid.tolist(), several.g.tolist(), strict=True))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, int | None], list[int]] = {}
            for txt, y, sid in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                g = group.get(sid)
                for w in {w.strip(PUNCTUATION) for w in set(txt.as_py().lower().split())}:
                    if w:
                        counts.setdefault((w, g), [0, 0])[y] += 1
            columns = [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())]
            yield pa.record_batch(columns, names=["w", "g", "t", "c"])

    def once(name: str) -> Column:
        """The number of texts, or one for all of a group."""
        return F.when(F.col("g").isNull(), F.sum(name)).otherwise(F.least(F.sum(name), F.lit(1))).alias(name)

    counted = train.select("text", "y", "sid").mapInArrow(words, "w string, g bigint, t bigint, c bigint").groupBy("w", "g").agg(once("t"), once("c"))
    frequencies = staged(counted.groupBy("w").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxicity-words")
    chance = chance_log10(F.col("t"), F.col("c"), share)
    likelier = (F.col("t") + 0.5) * (clean + 1) >= LIKELIER * (F.col("c") + 0.5) * (toxic + 1)  # whatever the base rate
    kept = frequencies.where((F.col("t") >= LEAST) & likelier & (chance <= math.log10(CHANCE))).orderBy(chance, "w").limit(TERMS).toPandas()
    weight = np.log((kept.t + 0.5) / (toxic + 1)) - np.log((kept.c + 0.5) / (clean + 1))
    terms = dict(zip(kept.w, (weight.clip(0.1, 8) / 4).tolist(), strict=True))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(terms)
        for batch in batches:
            found = [w for w in batch.column(0).to_pylist() if w not in terms and automaton.match(w)]
            yield pa.record_batch([pa.array(found, pa.string())], names=["w"])

    # A form that clean texts have at least as often as the label's share lets expect is a word of its own. Bounded by the sample.
    ordinary = frequencies.where(F.col("c") * share >= F.col("t") * (1 - share)).select("w")
    clean = frozenset(r.w for r in ordinary.mapInArrow(near, "w string").collect())
    model = Model(terms, clean, np.zeros(0))
    x_y = train.select(features_of(model)(F.col("text")).alias("x"), "y").toPandas()  # a row of six numbers for each sampled text
    model.weights = logistic(np.stack(x_y.x.to_numpy()), x_y.y.to_numpy("f8"))
    return model


def features_of(model: Model):
    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([model.features(t).tolist() for t in texts])

    return features


def scorer(model: Model):
    """A function of a text column that gives its score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="f8")

    return score


def score_documents(docs: DataFrame, model: Model, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; predicted is 1 from a score of 0.5."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), held_out.alias("held_out"), scorer(model)(F.col(f"`{text}`")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
