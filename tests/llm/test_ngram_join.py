import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from edge import docs, words

from tributary.llm import ngram_join as N
from tributary.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def expected(rows):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    least = {r: min((rows[k][0] for k in ks if rows[k][0] is not None), default=None) for r, ks in groups.items()}
    return Counter((rows[k][0], len(sets[k]), least[root(k)]) for k in range(len(rows)))


def test_against_brute_force(odd, odd_rows):
    assert Counter(map(tuple, N.ngram_join(odd).collect())) == expected(odd_rows)


def test_in_small_batches_and_blocks(spark, odd, odd_rows, small_batches, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 4)
    monkeypatch.setattr(N, "PAIRS", 2)
    monkeypatch.setattr(N, "KEYS", 1)
    monkeypatch.setattr(N, "BLOCK_NODES", 3)
    monkeypatch.setattr(N, "HELD", 5)
    assert Counter(map(tuple, N.ngram_join(odd).collect())) == expected(odd_rows)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Tiles of many blocks: links and candidates stay in proportion to nodes, and the blocks' components meet."""
    import random

    monkeypatch.setattr(N, "BLOCK_NODES", 16)
    rng = random.Random(2)
    base = words(rng, 120).split()
    rows = []
    for i in range(1000):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"x{i}"
        rows.append((i, " ".join(copy), None, None, None))
    counts = {}
    plain = N.staged

    def counting(frame, name, *rest):
        out = plain(frame, name, *rest)
        counts[name] = counts.get(name, 0) + (out.count() if name in ("tile-pairs", "sample-links", "tile-links") else 0)
        return out

    monkeypatch.setattr(N, "staged", counting)
    found = N.ngram_join(docs(spark, rows)).collect()
    assert {r.component_id for r in found} == {0} and len(found) == 1000
    assert counts["tile-pairs"] <= 1000 and counts["sample-links"] <= 20_000


def test_without_broadcasts(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_ROWS", -1)
    assert Counter(map(tuple, N.ngram_join(odd).collect())) == expected(odd_rows)


def test_texts_at_the_threshold(spark):
    """Overlap 3 of 4 shingles links, 2 of 3 does not."""
    data = [(1, "a b c d e f g h", None, None, 0), (2, "a b c d e f g", None, None, 0), (3, "q r s t u v w", None, None, 0), (4, "q r s t u v", None, None, 0)]
    got = {r.doc_id: r.component_id for r in N.ngram_join(docs(spark, data)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_empty(none):
    assert N.ngram_join(none).count() == 0


def test_one_row_of_each_group_stays(odd, odd_rows):
    left = N.one_of_each_group(odd)
    assert left.columns == odd.columns
    ids = {i for (i, _, c) in expected(odd_rows) if i == c}
    assert {r.doc_id for r in left.collect()} == ids


@pytest.mark.parametrize("seed", range(3))
def test_the_bitmap_bound_holds(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400, dtype="u8")
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        maps = [N.bitmap(a), N.bitmap(b)]
        x, y = N.folded(maps, min(map(len, maps)))
        apart = int(np.bitwise_count(x ^ y).sum())
        assert (len(a) + len(b) - apart) // 2 >= len(np.intersect1d(a, b))


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(200, 300)] + [(5, 5)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**dict.fromkeys(range(100, 161), 100), 1: 1, **dict.fromkeys(range(200, 300), 1)}


def test_words_are_cut_at_the_six_characters_only():
    import random

    text = "É b \x1c c\x0bD " + words(random.Random(1), 3)
    assert len(N.word_hashes(text)) == len(WORD.findall(text))
    assert len(N.shingles(text)) == len(shingle_set(text))
    words_ = WORD.findall(text.translate(FOLD)) + ["É", "é"]
    assert len(set(np.concatenate([N.word_hashes(w) for w in words_]).tolist())) == len(set(words_))


def test_rows_with_a_partner():
    """Nothing that has a partner of another component goes, and lone rows go."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        m = int(rng.integers(1, 30))
        key, n = rng.integers(0, 5, m), rng.integers(4, 30, m)
        order = np.lexsort((n, key))
        key, n = key[order].astype("i8"), n[order].astype("i4")
        comp, most = rng.integers(0, 4, m), (n + rng.integers(-6, 6, m)).astype("i4")
        alive = set(N.with_partner(key, comp, n, most).tolist())
        for i in range(m):
            fits = [j for j in range(m) if j != i and key[i] == key[j] and n[j] <= most[i] and n[i] <= most[j]]
            if any(comp[j] != comp[i] for j in fits):
                assert i in alive
            if not fits:
                assert i not in alive
