"""Toxicity, language, fingerprints and mixing."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from edge import docs, labels, words
from pyspark.sql import functions as F

from tributary.llm import language_id as L
from tributary.llm import mixing as M
from tributary.llm import order_minhash as O
from tributary.llm import queries
from tributary.llm.folds import fold
from tributary.llm.toxicity import LexiconAutomaton, Model, allowed_edits, fit, score_documents

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distances():
    rng = random.Random(1)
    some = lambda low, high: "".join(rng.choice("abc") for _ in range(rng.randrange(low, high)))
    terms = {some(2, 12) for _ in range(25)}
    automaton = LexiconAutomaton(terms)
    for _ in range(3000):
        word = some(0, 14)
        near = sorted((d, t) for t in terms if (d := distance(word, t)) <= allowed_edits(t))
        assert automaton.match(word) == ((near[0][1], near[0][0]) if near else None)


def test_automaton_forgets_states_and_goes_on():
    automaton = LexiconAutomaton(["abcdefghij"])
    automaton.MOST_STATES = 3
    for word in itertools.product("abz", repeat=4):
        automaton.match("".join(word))
    assert automaton.match("abcdefzhij") == ("abcdefghij", 1)


def test_context_tells_quotation_from_abuse():
    model = Model({"scoundrel": 1.0}, frozenset({"scoundrels"}), np.zeros(0))
    exact, misspelled, quoted, addressed = range(4)
    assert model.features("what a scoundrel")[exact] > 0
    assert model.features("what a scoundrell!")[misspelled] > 0
    assert not model.features("what scoundrels").any()
    for text in ('they said "scoundrel" twice', "the word scoundrel is old", "« le scoundrel »"):
        assert model.features(text)[quoted] > 0 and not model.features(text)[exact]
    assert model.features("you scoundrel")[addressed] > 0
    assert not model.features(None).any()


def test_toxicity_on_held_out_rows(spark):
    found = queries.op2_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.toxic).mean() > 0.97
    assert found[found.toxic == 1].predicted.mean() > 0.9 and found[found.predicted == 1].toxic.mean() > 0.9
    assert ((found.score >= 0) & (found.score <= 1)).all() and ((found.score >= 0.5) == (found.predicted == 1)).all()


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    held = fold(F.col("doc_id"), 5) == 0
    turned = marks.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.score for r in score_documents(frame, fit(frame, m.where(~held)), held).collect()} for m in (marks, turned)]
    assert scores[0] == scores[1]


def test_a_rare_term_is_learned_but_not_the_words_of_copies(spark):
    """400 toxic texts of 2,000: twenty hold one term and its misspelling is found, and twenty are near copies of one text."""
    rng = random.Random(6)
    texts = [words(rng, 40) for _ in range(2000)]
    for i in range(400):
        texts[i] += " blackguard" if i < 20 else " villain"
    copy = "here stands " + words(rng, 60, 10**9)
    for i in range(380, 400):
        texts[i] = f"{copy} {words(rng, 2)} villain"
    frame = docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    model = fit(frame, labels(spark, [(i, 1, int(i < 400)) for i in range(2000)]))
    assert {"blackguard", "villain"} == set(model.terms)
    assert model.score("what a blakguard") > 0.5 > model.score(copy)


def test_a_rare_term_of_many_toxic_texts(spark):
    """The support that a term needs does not rise with the number of toxic texts: 15 of 1,800 are under a hundredth."""
    rng = random.Random(7)
    texts = [words(rng, 20) + (" blackguard" if i < 15 else " villain" if i < 1800 else "") for i in range(6000)]
    frame = docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    assert set(fit(frame, labels(spark, [(i, 1, int(i < 1800)) for i in range(6000)])).terms) == {"blackguard", "villain"}


def test_a_term_that_clean_texts_quote_as_often(spark):
    """220 toxic texts of 2,000: 60 of them and 60 clean ones have the term, which is eight times likelier in a toxic one."""
    rng = random.Random(8)
    texts = [words(rng, 20) for _ in range(2000)]
    texts = [t + (" you blackguard" if i < 60 else " you villain" if i < 220 else ' they wrote "blackguard"' if i < 280 else "") for i, t in enumerate(texts)]
    frame = docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    model = fit(frame, labels(spark, [(i, 1, int(i < 220)) for i in range(2000)]))
    assert {"blackguard", "villain"} <= set(model.terms)
    assert model.score("w1 w2 you blackguard") > 0.5 > model.score('w1 w2 they wrote "blackguard"')


def test_toxicity_of_odd_rows(odd, odd_rows, none, spark):
    held = fold(F.col("doc_id"), 5) == 0
    marks = labels(spark, [(i, 1, i % 2) for i in range(30)] + [(3, None, None), (None, 1, 1)])
    got = score_documents(odd, fit(odd, marks), held).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((r[0], r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in odd_rows)
    unlabelled = fit(odd, labels(spark, []))
    assert {r.score for r in score_documents(odd, unlabelled, held).collect()} == {0.0}
    assert score_documents(none, fit(none, marks), held).count() == 0


def test_toxicity_against_a_plain_version(spark):
    """The lexicon by counting words of plain sets of texts, the matches by edit distances to every term, the fit on the same features."""
    rng = random.Random(3)
    long = "x" * 60  # no word is too long to be learned
    texts = [words(rng, 15, 10**6) + (f" you {rng.choice(['blackguard', 'villain', long])}" if i < 120 else " he said villain" if i < 125 else "") for i in range(900)]
    toxic = [i < 120 for i in range(900)]
    tried = ["you blakguard", "vilain!", "he said a villain", "", None, "x" * 59, "x" * 57 + "yyy", "blackguards you vllain", *texts[100:140]]
    frame = docs(spark, [(i, t, None, None, 0) for i, t in enumerate([*texts, *tried])])
    model = fit(frame, labels(spark, [(i, 1, int(t)) for i, t in enumerate(toxic)]))
    count = [Counter(w for t, y in zip(texts, toxic, strict=True) if y == side for w in set(t.split())) for side in (False, True)]
    share, weights = 120 / 900, {}
    for w, t in count[1].items():
        c, q = count[0][w], t / (t + count[0][w])
        n = t + c
        chance = -n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else 0)) / math.log(10) if q > share else 0
        if t >= 3 and chance <= -6 and (t + 0.5) / 121 >= 2 * (c + 0.5) / 781:
            weights[w] = min(8, max(0.1, math.log((t + 0.5) / 121) - math.log((c + 0.5) / 781))) / 4
    assert set(weights) >= {"blackguard", "villain", long} and model.terms == pytest.approx(weights)

    def nearest(word):
        near = min(((d, t) for t in weights if (d := distance(word, t)) <= allowed_edits(t)), default=None)
        return near and (near[1], near[0])

    for t in texts + tried:
        for w in (t or "").lower().split():
            bare = w.strip("!")
            assert (model.automaton.match(bare) if bare else None) == (nearest(bare) if bare else None)
    got = {r.doc_id: r.score for r in score_documents(frame, model, F.lit(False)).collect()}
    for i, t in enumerate([*texts, *tried]):
        x = np.concatenate([[1], model.features(t)])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, float(x @ model.weights))))))


def test_language_against_a_plain_version(odd, odd_rows):
    """Prototypes as sums of bound letters of all learned texts, one trigram after another."""
    two, one, zero = L.letter_vectors()
    codes = L.letter_codes()

    def profile(text):
        seq = [0]
        for c in text or "":
            code = int(codes[ord(c)])
            if code or seq[-1]:
                seq.append(code)
        seq += [0] if seq[-1] else []
        return sum((two[a].astype(int) * one[b] * zero[c] for a, b, c in zip(seq, seq[1:], seq[2:], strict=False)), np.zeros(L.DIMENSIONS))

    rows = [r for r in odd_rows if r[0] is not None and len(r[1] or "") < 5000]
    totals = {}
    for i, t, lang, *_ in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            totals[lang] = totals.get(lang, 0) + profile(t)
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 4)) for r in L.identify(docs(odd.sparkSession, rows), fold(F.col("doc_id"), 3) == 1).collect())
    expected = Counter()
    for i, t, *_ in rows:
        p = profile(t)
        near = max((float(p @ v / (np.linalg.norm(p) * np.linalg.norm(v))), name) for name, v in totals.items()) if any(codes[ord(c)] for c in t or "") else (0.0, "und")
        expected[i, near[1], round(min(1, max(0, near[0])), 4)] += 1
    assert sum((got - expected).values()) <= 0.02 * len(rows)  # rounding of the fourth place


def test_language_on_held_out_rows(spark):
    found = queries.op3_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.98


def test_language_of_odd_rows(odd, odd_rows, none):
    held = fold(F.col("doc_id"), 3) == 1
    got = L.identify(odd, held).collect()
    assert len(got) == len(odd_rows)
    texts = {r[0]: r[1] for r in odd_rows if r[0] is not None and r[0] != 20}
    for r in got:
        if r.doc_id in texts:
            letters = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert r.lang_pred in (("en", "fr") if letters else ("und",))
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    assert L.identify(none, held).count() == 0
    assert {r.lang_pred for r in L.identify(odd, F.lit(True)).collect()} == {"und"}


def test_profiles_are_bundles_of_bound_letters():
    two, one, zero = L.letter_vectors()
    codes = [0, *(ord(c) - 96 for c in "abca"), 0, *(ord(c) - 96 for c in "b"), 0]
    total = sum((two[a].astype(int) * one[b] * zero[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)), np.zeros(L.DIMENSIONS, int))
    assert (L.profiles(["Abca, 7 B!"])[0] == total).all()


def plain_fingerprint(text):
    hashes = O.kmers(text).tolist()
    seen, keys = Counter(), []
    for h in hashes:
        keys.append(int(O.mixed(np.array([h], "u8") + np.array([seen[h]], "u8") * O.SEEDS[-2])[0]))
        seen[h] += 1
    out = []
    for s in range(O.SLOTS):
        ranks = [(k * int(O.SEEDS[s])) % 2**64 for k in keys]
        ranks = [r ^ (r >> 31) for r in ranks]
        value = 0
        for at in sorted(sorted(range(len(ranks)), key=lambda i: ranks[i])[: O.TUPLE]):
            value = (value * 0x9E3779B97F4A7C15 + hashes[at] + 1) % 2**64
        out.append(value)
    return (O.mixed(np.array(out, "u8")) >> np.uint64(32)).tolist() if hashes else [0] * O.SLOTS


def test_fingerprints_against_plain_ones():
    for text in ("", "a", "abcdefgh", "abcdefghi", "ab" * 40, words(random.Random(1), 50)):
        assert O.fingerprint(text).tolist() == plain_fingerprint(text)


def test_fingerprints_tell_order():
    a, b = (words(random.Random(k), 300, 10**6) for k in (1, 2))
    whole = O.fingerprint(a + " " + b)
    assert O.likeness(whole, O.fingerprint(a + " " + b)) == 1
    assert O.likeness(whole, O.fingerprint(b + " " + a)) < 0.85 < O.likeness(whole, O.fingerprint(a + " " + b + " z"))


def report(rows):
    ordered = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = Counter()
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        edited = O.edited_text(t, after)
        prints = [O.fingerprint(x) for x in (t, edited, after)]
        out[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), O.as_text(prints[0]), O.as_text(prints[1]), O.likeness(prints[0], prints[1]), O.likeness(prints[0], prints[2])] += 1
    return out


def test_edit_report(odd, odd_rows, none, small_batches, spark):
    rows = [r for r in odd_rows if len(r[1] or "") < 50_000]
    assert Counter(map(tuple, O.edit_report(docs(spark, rows)).collect())) == report(rows)
    for some in ([r for r in rows if r[0] is None], rows[:1]):
        assert Counter(map(tuple, O.edit_report(docs(spark, some)).collect())) == report(some)
    assert O.edit_report(none).count() == 0


DOMAIN = "case when quality = 1 then 'clean' when quality = 0 then 'poor' end"


def mixed_corpus(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(5, 60)) if i % 4 else " ".join("#" + w for w in words(rng, 30).split()), None, None, 0) for i in range(400)]
    return docs(spark, rows), labels(spark, [(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)])


def test_targets_are_met(spark):
    frame, marks = mixed_corpus(spark)
    got = M.mix_report(frame, marks, F.expr(DOMAIN), {"clean": 0.3, "poor": 0.7}).toPandas()
    p, n = np.stack(got.posterior), got.n_tokens.to_numpy()
    reached = (p * (n * got.rate.to_numpy())[:, None]).sum(axis=0)
    assert np.allclose(reached / n.sum(), [0.3, 0.7], atol=1e-3) and (got.rate >= 0).all()
    assert (np.abs(got.copies - got.rate) < 1).all()
    assert p.argmax(axis=1).tolist() == [int(i % 4 == 0) for i in got.doc_id]


@pytest.mark.parametrize(("low", "high", "share"), [(0.4, 0.6, 0.55), (0.8, 0.95, 0.92)])
def test_targets_within_reach_of_overlapping_domains(spark, low, high, share):
    p = np.random.default_rng(5).uniform(low, high, 2000)
    members = spark.createDataFrame([(100, [x, 1 - x]) for x in p.tolist()], "n_tokens bigint, posterior array<double>").coalesce(2).cache()
    mixture = M.fit_mixture(members, M.Classifier(["a", "b"], np.full(2, 0.5), np.zeros((1, 2)), np.zeros((1, 2))), {"a": share, "b": 1 - share})
    assert np.allclose(mixture.totals, mixture.targets, rtol=2e-4)
    r = mixture.rates(np.stack([p, 1 - p], axis=1))
    assert np.allclose([100 * r @ p, 100 * r @ (1 - p)], mixture.targets, rtol=2e-4) and (r >= 0).all()


def test_a_fit_that_runs_out_of_rounds_warns(spark):
    members = spark.createDataFrame([(100, [0.9, 0.1]), (100, [0.2, 0.8])], "n_tokens bigint, posterior array<double>").coalesce(1)
    with pytest.warns(UserWarning, match="after 0 rounds"):
        M.fit_mixture(members, M.Classifier(["a", "b"], np.full(2, 0.5), np.zeros((1, 2)), np.zeros((1, 2))), {"a": 0.3, "b": 0.7}, rounds=0)


def test_rounds_against_a_plain_solver(spark):
    """Where the bound binds, the result is the constrained optimum: no single rate can be moved for the better."""
    frame, marks = mixed_corpus(spark)
    classifier = M.fit_classifier(frame, marks, F.expr(DOMAIN))
    members = M.memberships(frame, classifier)
    mixture = M.fit_mixture(members, classifier, {"clean": 1.0, "poor": 0.0}, least=0.5)
    table = members.toPandas()
    p, n = np.stack(table.posterior), table.n_tokens.to_numpy()
    r = mixture.rates(p)
    off = (p * (n * r)[:, None]).sum(axis=0) - mixture.targets
    weight = 1 / np.diag((p * n[:, None]).T @ p)
    slope = p @ (weight * off)
    assert (r >= 0.5).all() and (slope[r > 0.5 + 1e-6] < 1e-3).all() and (slope[r <= 0.5 + 1e-9] > -1e-3).all()


def test_a_mixture_that_drops_nothing(spark):
    frame, marks = mixed_corpus(spark)
    got = M.mix(frame, marks, F.expr(DOMAIN), {"clean": 0.5, "poor": 0.5}, total=math.inf, least=1.0)
    assert got.columns == frame.columns
    assert {r.doc_id for r in got.collect()} == set(range(400))


def test_the_whole_mixture_against_a_plain_version(spark):
    """Memberships from plain counts, rates from a plain solver of the same least squares."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(("good", "fine") if i % 4 else ("bad", "poor")) if rng.random() < 0.3 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(5, 40))) for i in range(200)]
    frame = docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    marks = labels(spark, [(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)])
    got = {r.doc_id: r for r in M.mix_report(frame, marks, F.expr("case quality when 1 then 'clean' else 'poor' end"), {"clean": 0.5, "poor": 0.5}).collect()}
    split = lambda t: np.array([M._feature(w) for w in t.split()])
    low = (1 << M.SHAPE_BITS) - 1
    tables = []
    for shift, size in ((M.SHAPE_BITS, 1 << M.WORD_BITS), (0, 1 << M.SHAPE_BITS)):
        table = np.full((size, 2), 0.5)
        for i in range(0, 200, 2):
            for f in split(texts[i]):
                table[(f >> shift) if shift else (f & low), 0 if i % 4 else 1] += 1
        table /= table.sum(axis=0)
        tables.append(np.log(table) - np.log(table.mean(axis=1, keepdims=True)))
    p, n = [], []
    for t in texts:
        f = split(t)
        logs = np.log(0.5) + sum(tables[0][f >> M.SHAPE_BITS] + tables[1][f & low]) * min(1, M.EVIDENCE / len(f))
        e = np.exp(logs - logs.max())
        p.append(e / e.sum())
        n.append(len(f))
    p, n = np.array(p), np.array(n)
    for i in range(200):
        assert got[i].n_tokens == n[i] and np.allclose(got[i].posterior, p[i], atol=1e-9)
    rates = np.array([got[i].rate for i in range(200)])
    target = n.sum() / 2
    assert (rates >= 0).all() and np.allclose((p * (n * rates)[:, None]).sum(axis=0), [target, target], rtol=2e-4)
    assert all(0 <= got[i].copies - math.floor(rates[i]) <= 1 for i in range(200))


@pytest.mark.parametrize("marked", [0, 40])
def test_mixing_of_odd_rows(odd, odd_rows, none, spark, marked):
    marks = labels(spark, [(i, i % 2, 0) for i in range(marked)] + [(None, 1, 1), (5, None, None)])
    got = M.mix_report(odd, marks, F.expr(DOMAIN), {"clean": 0.6, "poor": 0.4}).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert all(r.n_tokens == len((dict((x[0], x[1]) for x in odd_rows if x[0] not in (None, 20)).get(r.doc_id) or "").split()) for r in got if r.doc_id not in (None, 20))
    assert M.mix_report(none, marks, F.expr(DOMAIN), {"clean": 1.0}).count() == 0
