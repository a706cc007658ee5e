import hashlib
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.llm import exact_dedup as E
from tributary.llm.exact_dedup import drop_copies, exact_dedup

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_against_brute_force(odd, odd_rows):
    for runs, fan_in in ((64, 4), (5, 2), (1, 2)):
        assert Counter(map(tuple, exact_dedup(odd, runs=runs, fan_in=fan_in, verify_texts=True).collect())) == expected(odd_rows)


def test_smallest_id_can_stay(spark):
    from edge import docs

    got = exact_dedup(docs(spark, [(1, "A", None, None, 1), (2, "a", None, None, 1)]), keep="min").collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False)}


def test_rows_that_stay_keep_their_columns(odd, odd_rows):
    left = drop_copies(odd)
    assert left.columns == odd.columns
    stay = Counter(i for (i, _, _, kept, _), n in expected(odd_rows).items() if kept for _ in range(n))
    assert Counter(r.doc_id for r in left.collect()) == stay


def test_empty(none):
    assert exact_dedup(none).count() == 0
    assert drop_copies(none).count() == 0


def test_texts_are_compared(odd, monkeypatch):
    """A digest that lies is found, broadcast or not."""
    truth = E._folded
    monkeypatch.setattr(E, "_folded", lambda *a: truth(*a).withColumns({"digest": F.lit(b"same"), "n_bytes": F.lit(1), "second": F.lit(1).cast("bigint")}))
    for rows in (E.VERIFY_ROWS, -1):
        monkeypatch.setattr(E, "VERIFY_ROWS", rows)
        with pytest.raises(RuntimeError, match="differ"):
            exact_dedup(odd, verify_texts=True)


def test_a_round_merges_sorted_runs(spark):
    """One exchange and one sort a round; every run's entries come out in order, equal ones as one."""
    rows = [(run, key % 3, bytes([key]), 1, key, (True, 10 * run + key), 1) for run in range(6) for key in range(run % 2, 12, 2)]
    entries = spark.createDataFrame(rows, "run int, slice int, digest binary, n_bytes int, second bigint, best struct<b:boolean,id:bigint>, n bigint")
    one = E.merged(entries, 3, F.max)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "SortAggregate" in plan
    parts = [[(r.run, r.slice, bytes(r.digest)) for r in p] for p in one.rdd.glom().collect()]
    assert all(p == sorted(p) for p in parts)
    got = {(r.run, bytes(r.digest)[0]): (r.best.id, r.n) for r in one.collect()}
    assert got == {(half, k): (max(10 * r + k for r in runs if r % 2 == k % 2), sum(r % 2 == k % 2 for r in runs)) for half, runs in enumerate(([0, 1, 2], [3, 4, 5])) for k in range(12)}


def test_no_python_in_the_plan(odd):
    plan = exact_dedup(odd, verify_texts=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
