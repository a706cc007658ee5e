import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from edge import docs
from pyspark.sql import functions as F

from tributary.llm import suffix_dedup as S
from tributary.llm.suffix_sort import deep_shallow_sort


def expected(rows, length):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    out = Counter()
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out[i, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "limit", "steps"), [(400, S.LIMIT, S.STEPS), (400, 3, (48, 7)), (80, 2, (16,)), (80, 1, ())])
def test_against_brute_force(odd, odd_rows, length, limit, steps, small_batches, monkeypatch):
    monkeypatch.setattr(S, "LIMIT", limit)
    monkeypatch.setattr(S, "SALTS", 3)
    rows = [r for r in odd_rows if len(r[1] or "") < 50_000]
    frame = docs(odd.sparkSession, rows)
    assert Counter(map(tuple, S.suffix_digests(frame, length=length, k=16 if length < 100 else S.K, limit=limit, steps=steps).collect())) == expected(rows, length)


def test_without_broadcasts_and_in_chunks(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(S, "CHUNK", 50)
    rows = [r for r in odd_rows if len(r[1] or "") < 50_000]
    assert Counter(map(tuple, S.suffix_digests(docs(odd.sparkSession, rows), length=100, k=20).collect())) == expected(rows, 100)


def test_a_passage_that_most_texts_share(spark, monkeypatch):
    """A hot anchor whose contexts differ: parts by cores fit a task or are one string."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, rows = word(130), []
    for i in range(60):
        tail = passage[100:] + word(3) if i % 7 else word(40)
        rows.append((i, word(rng.randrange(90)) + passage[: rng.randrange(90, 131)] + tail + word(rng.randrange(60)), None, None, None))
    monkeypatch.setattr(S, "LIMIT", 8)
    for limit in (8, 25):
        assert Counter(map(tuple, S.suffix_digests(docs(spark, rows), length=80, k=16, limit=limit, steps=(12, 5)).collect())) == expected(rows, 80)


def test_offsets_that_neighbours_leave_open(spark, monkeypatch):
    """Members that agree with others on both sides, but not with those next to them in either order."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    core, sides = word(40), [[word(20) for _ in range(5)] for _ in range(4)]
    picked = [[rng.choice(s) for s in sides] for _ in range(50)]
    rows = [(i, a + word(2) * (i % 2) + b + core + c + word(2) * (i % 3 == 0) + d, None, None, None) for i, (a, b, c, d) in enumerate(picked)]
    open_, asked = [], S._asked
    monkeypatch.setattr(S, "_asked", lambda members, *rest: open_.append(members.count()) or asked(members, *rest))
    monkeypatch.setattr(S, "LIMIT", 4)
    monkeypatch.setattr(S, "NEAR", 1)
    assert Counter(map(tuple, S.suffix_digests(docs(spark, rows), length=80, k=16, limit=4, steps=(12,)).collect())) == expected(rows, 80)
    assert sum(open_)


def test_no_anchor_goes_to_one_task(spark):
    """The exchange of places leaves out what is met often."""
    found = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("fp"), F.col("id").alias("tid"), F.lit(0).cast("bigint").alias("pos"))
    rows = S._shared(found, crowds=10).collect()
    assert len(rows) == 6668 and {r.fp for r in rows} == {7} and {r.n for r in rows} == {6668}


def test_a_very_long_text(odd):
    assert S.suffix_digests(odd).count() == odd.count()


def test_empty(none):
    assert S.suffix_digests(none).count() == 0


def test_sorting_against_plain_sorting():
    rng = random.Random(5)
    for _ in range(500):
        strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 40))})
        order, parts = deep_shallow_sort(strings, 0, rng.randrange(5))
        assert [strings[k] for k in order] == sorted(strings)
        assert parts[1:] == [len(os.path.commonprefix([strings[a], strings[b]])) for a, b in zip(order, order[1:], strict=False)]


def test_equal_windows_have_equal_anchors():
    rng = random.Random(6)
    shared = bytes(rng.choice(b"abcd") for _ in range(60))
    for _ in range(50):
        texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(50))) + shared + bytes(rng.choice(b"abcd") for _ in range(50)) for _ in range(2)]
        where = [set(S.anchors(t, 60, 8)[0] - t.index(shared)) for t in texts]
        assert any(0 <= p <= 52 for p in where[0] & where[1])
