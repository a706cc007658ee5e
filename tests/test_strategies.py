"""Strategies against a nested-loop definition, edge cases and plans."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary import Predicate, join
from tributary.functions.names import free_names
from tributary.operators.batch import bucket_order_trusted, measured_bytes, write_presorted
from tributary.operators.ranking import row_numbers
from tributary.plans import flush
from tributary.plans.queries import LAYOUT

BATCH = ["nested_loop", "block_nested_loop", "ordered_merge", "sort_merge", "simple_hash"]
KEY = Predicate.equi("a", "b")

#: Left and right keys of the fixtures in FIXTURES.md, with the rows that they give.
FIXTURES = {
    "duplicates": ([1, 3, 3, 3, 3, 3, 3, 3, 3, 4, 7, 18], [0, 1, 3, 3, 3, 7, 42, 45], 26),
    "one key": ([0] * 6, [0] * 6, 36),
    "reversed": (list(range(20)), list(range(19, -1, -1)), 20),
    "rotated": (list(range(20)), [*range(10, 20), *range(10)], 20),
    "empty left": ([], [1], 0),
    "empty right": ([1], [], 0),
    "nulls": ([1, None], [1, None], 1),
}


def frames(spark, left, right):
    return (spark.createDataFrame([(x,) for x in left], "a int"), spark.createDataFrame([(x,) for x in right], "b int"))


def known(spark):
    """Sides whose size Catalyst knows."""
    return spark.range(9).select(F.col("id").alias("a")), spark.range(9).select(F.col("id").alias("b"))


@pytest.mark.parametrize("strategy", BATCH)
@pytest.mark.parametrize("fixture", list(FIXTURES))
def test_fixture(spark, strategy, fixture):
    left, right, n = FIXTURES[fixture]
    rows = join(*frames(spark, left, right), KEY, strategy).collect()
    assert len(rows) == n and all(a == b for a, b in rows)


def test_random_inputs_agree_with_the_definition(spark):
    rng = random.Random(7)
    for _ in range(2):
        left = [rng.choice([None, *range(5)]) for _ in range(rng.randrange(30))]
        right = [rng.choice([None, *range(5)]) for _ in range(rng.randrange(30))]
        plain = Counter((x, y) for x in left for y in right if x is not None and x == y)
        safe = Counter((x, y) for x in left for y in right if x == y)
        for strategy in BATCH:
            assert Counter(map(tuple, join(*frames(spark, left, right), KEY, strategy).collect())) == plain
            null_safe = Predicate.equi("a", "b", null_safe=True)
            assert Counter(map(tuple, join(*frames(spark, left, right), null_safe, strategy).collect())) == safe


def test_nan(spark):
    left = spark.createDataFrame([(math.nan,), (0.0,)], "a double")
    right = spark.createDataFrame([(math.nan,), (-0.0,)], "b double")
    assert join(left, right, KEY).count() == 2
    assert join(left, right, Predicate.equi("a", "b", nan_never_matches=True)).count() == 1


def test_nan_rule_leaves_other_types_alone(spark):
    left, right = spark.createDataFrame([("x",), ("NaN",)], "a string"), spark.createDataFrame([("x",), ("NaN",)], "b string")
    assert join(left, right, Predicate.equi("a", "b", nan_never_matches=True)).count() == 2


@pytest.mark.parametrize("strategy", BATCH)
def test_keys_of_two_types(spark, strategy):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([("1",), ("2.5",), ("01",), ("two",), (None,)], "b string")
    assert sorted(map(tuple, join(left, right, KEY, strategy).collect())) == [(1, "01"), (1, "1")]
    assert sorted(map(tuple, join(right, left, Predicate.equi("b", "a"), strategy).collect())) == [("01", 1), ("1", 1)]
    wide = spark.createDataFrame([(1,), (2**40,)], "b bigint")
    assert [tuple(r) for r in join(left, wide, KEY, strategy).collect()] == [(1, 1)]


def test_equal_keys_of_two_types_are_dealt_alike(spark):
    left, right = spark.createDataFrame([(1,), (0,)], "a int"), spark.createDataFrame([(1.0,), (-0.0,)], "b double")
    lp, rp = KEY.partitions(left, right, 1000)
    assert [r[0] for r in left.alias("l").select(lp).collect()] == [r[0] for r in right.alias("r").select(rp).collect()]


def test_order_coarser_than_the_match(spark):
    rng = random.Random(4)
    left, right = [rng.randrange(40) for _ in range(60)], [rng.randrange(40) for _ in range(60)]
    pred = Predicate.ordered(lambda c: F.floor(c("a") / 10), lambda c: F.floor(c("b") / 10), lambda l, r: l("a") <= r("b"))
    expected = Counter((x, y) for x in left for y in right if x // 10 == y // 10 and x <= y)
    assert Counter(map(tuple, join(*frames(spark, left, right), pred).collect())) == expected


def test_swap_keeps_rows(spark):
    left, right = frames(spark, [2], [1, 2])
    assert join(right, left, KEY.swap(), "sort_merge").collect() == [(2, 2)]


@pytest.mark.parametrize(("config", "expected"), [({}, []), ({"mode": "bag", "order_by": ["v"]}, ["b"]), ({"mode": "bag", "order_by": ["v"], "block_rows": 1}, [])])
def test_anti_modes_on_a_repeated_key(spark, config, expected):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "a int, v string")
    right = spark.createDataFrame([(1,)], "b int")
    assert [r.v for r in join(left, right, KEY, "anti", **config).collect()] == expected


def test_anti_set(spark):
    left, right = frames(spark, range(60), range(50))
    assert sorted(r.a for r in join(left, right, KEY, "anti").collect()) == list(range(50, 60))
    assert join(left, right.limit(0), KEY, "anti").count() == 60


def test_bag_anti_against_a_model(spark):
    rng = random.Random(3)
    left = [(rng.choice([None, 0, 1, 2]), i) for i in range(40)]
    right = [rng.choice([None, 0, 1, 3]) for _ in range(9)]
    for block, hot in ((None, 10**6), (None, 5), (7, 10**6), (7, 3)):
        expected = []
        for at in range(0, 40, block or 40):
            held = {}
            for k, i in left[at : at + (block or 40)]:
                held.setdefault(k, []).append(i)
            for k in right:
                if k is not None and held.get(k):
                    held[k][0] = held[k][-1]
                    held[k].pop()
            expected += [i for v in held.values() for i in v]
        got = join(spark.createDataFrame(left, "a int, i int"), spark.createDataFrame([(k,) for k in right], "b int"), KEY, "anti", mode="bag", order_by=["i"], block_rows=block, hot_rows=hot)
        assert sorted(r.i for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("hot", [10**6, 0])
def test_bag_anti_keeps_the_callers_columns(spark, hot):
    names = ["block", "rows", "number", "__block", "__rn", "AT"]
    left = spark.createDataFrame([(1, *range(10 * i, 10 * i + 6)) for i in (1, 2)], "a int, " + ", ".join(f"`{n}` int" for n in names))
    right = spark.createDataFrame([(1,)], "b int")
    for order, block in (("block", None), ("__rn", None), ("AT", 1), ("number", 7)):
        got = join(left, right, KEY, "anti", mode="bag", order_by=[order], block_rows=block, hot_rows=hot)
        assert got.columns == left.columns
        assert [tuple(r) for r in got.collect()] == ([] if block == 1 else [(1, 20, 21, 22, 23, 24, 25)])


def test_free_names():
    assert free_names(["A", "b_"], "a", "a", "b", "c") == ["a_", "a__", "b", "c"]


def test_row_numbers_keep_names_and_types(spark):
    frame = spark.createDataFrame([(3, 1), (1, 2), (2, None)], "at int, part int")
    rows = row_numbers(frame, [], [F.col("at")], "n")
    assert rows.columns == ["at", "part", "n"] and sorted(map(tuple, rows.collect())) == [(1, 2, 1), (2, None, 2), (3, 1, 3)]


def test_row_numbers_over_a_hot_key(spark):
    frame = spark.range(1000).select((F.col("id") % 10 == 0).alias("k"), F.col("id").alias("v"))
    rows = row_numbers(frame, [F.col("k")], [F.col("v")], "n").collect()
    for k in (True, False):
        got = sorted((r.v, r.n) for r in rows if r.k == k)
        assert [n for _, n in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize(("strategy", "node"), [("nested_loop", "CartesianProduct"), ("block_nested_loop", "BroadcastNestedLoopJoin"), ("sort_merge", "SortMergeJoin"), ("simple_hash", "ShuffledHashJoin")])
def test_the_hint_decides_the_plan(spark, strategy, node):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = join(*known(spark), KEY, strategy)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert node in plan


def test_a_large_side_is_not_broadcast(spark):
    plan = join(*known(spark), KEY, "block_nested_loop", broadcast_limit=0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan


def test_sizes_count_what_strings_hold(spark):
    small, large = spark.createDataFrame([("x",)], "b string"), spark.createDataFrame([("x" * 100_000,)], "b string")
    assert measured_bytes(small) < 100 and measured_bytes(large) > 100_000
    left = spark.createDataFrame([("x",)], "a string")
    plan = join(left, large, KEY, "block_nested_loop", broadcast_limit=50_000)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan


def test_presorted_tables_merge_without_exchange_or_sort(spark):
    before = spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sides = [write_presorted(f, f"sorted_{c}", [c]) for f, c in zip(known(spark), "ab", strict=True)]
        with bucket_order_trusted(spark):
            plan = join(*sides, KEY, "ordered_merge")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == before


def adaptive_model(sizes, a, b):
    """The rule, in 32-bit floats."""
    tl, tr = sum(l for _, l, _ in sizes), sum(r for _, _, r in sizes)
    even = lambda x, y: abs(np.float32(x) / np.float32(tl + tr) - np.float32(y) / np.float32(tl + tr)) < np.float32(b)
    prefer = lambda some, flag: [s for s in some if flag(s)] or some
    enough = lambda s: s[1] >= a and s[2] >= a
    if even(tl, tr):
        some = prefer(prefer(sizes, enough), lambda s: even(tl - s[1], tr - s[2]))
    else:
        some = prefer([s for s in sizes if (s[1] >= s[2] if tl >= tr else s[2] >= s[1])], enough)
    return max(some, key=lambda s: (s[1] + s[2], s[0]))[0]


def test_the_adaptive_policy_at_its_bound(spark):
    rng = random.Random(5)
    cases = [([(0, 1, 1), (1, 2, 4), (2, 6, 1)], 2, 0.2)]
    while len(cases) < 12:  # layouts at which doubles would decide otherwise
        sizes = [(i, rng.randrange(8), rng.randrange(8)) for i in range(4)]
        n = sum(l + r for _, l, r in sizes)
        b = rng.choice([0.1, 0.2, 0.25, 0.3])
        if n and any(abs(abs(sum(l - r for j, l, r in sizes if j != i)) / n - b) < 1e-6 for i in (0, 1, 2, 3, 9)):
            cases.append((sizes, 2, b))
    for sizes, a, b in cases:
        assert flush.flush_adaptive(spark.createDataFrame(sizes, "part int, l bigint, r bigint"), a, b).first().part == adaptive_model(sizes, a, b), (sizes, b)


def test_policies_on_the_published_layout(spark):
    stats = spark.createDataFrame(LAYOUT, "part int, l bigint, r bigint")
    assert flush.flush_smallest(stats).first().part == 3
    assert flush.flush_largest(stats).first().part == 4
    for (a, b), part in {(10, 0.25): 1, (10, 0.10): 2, (1, 0.10): 4}.items():
        assert flush.flush_adaptive(stats, a, b).first().part == part


@pytest.mark.parametrize(("strategy", "config"), [("simple_hash", {"memory_rows": 0}), ("block_nested_loop", {"block_rows": 0}), ("anti", {"mode": "bag", "order_by": ["a"], "block_rows": 0})])
def test_zero_limits_are_refused(spark, strategy, config):
    with pytest.raises(ValueError, match="positive"):
        join(*frames(spark, [1], [1]), KEY, strategy, **config)


def test_name_clashes_need_suffixes(spark):
    left = spark.createDataFrame([(1, 2)], "a int, x int")
    right = spark.createDataFrame([(1, 3)], "b int, x int")
    with pytest.raises(ValueError, match="both sides"):
        join(left, right, KEY)
    assert join(left, right, KEY.with_suffixes("_l", "_r")).columns == ["a", "x_l", "b", "x_r"]
