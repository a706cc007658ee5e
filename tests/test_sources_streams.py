import types
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary import Predicate, join
from tributary.plans.metrics import measure
from tributary.sources import staging
from tributary.sources.readers import from_concat_json, from_ndjson, rows_of, split_json, stage_as_stream_source, stream_from_dir
from tributary.sources.runs import RunStore
from tributary.sources.tee import tee, tee_stream
from tributary.streaming.metrics import expected_reads_one_in_ten, progress_curve
from tributary.streaming.phased import HashMerge, ProgressiveMerge, XJoin, play
from tributary.streaming.progressive import DISK_STATE, HEAP_STATE, StateLimitExceeded, run

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), True)])


def test_concatenated_json_in_any_layout(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id":1,"name":"a"}{"id":2,"name":"b"}\n{"id":\n3,\n"name":"c"} ')
    assert sorted(map(tuple, from_concat_json(spark, f"file://{tmp_path}", SCHEMA).collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_large_concatenated_file_raises_before_it_is_read(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id":1}' * 20)
    with pytest.raises(ValueError, match="160 bytes"):
        from_concat_json(spark, f"file://{tmp_path}", SCHEMA, max_file_bytes=100)


def test_an_incomplete_tail_raises():
    with pytest.raises(ValueError):
        list(split_json('{"a":1}{"a":'))


@pytest.mark.parametrize("line", ['{"name":"x"}', '{"id":"x"}', '{"id":18446744073709551615}'])
def test_strict_json(spark, tmp_path, line):
    (tmp_path / "x.json").write_text('{"id":1,"extra":2}\n' + line)
    with pytest.raises(Exception, match="(?s)."):
        from_ndjson(spark, f"file://{tmp_path}", SCHEMA).collect()


def test_unsigned_values_fit_a_decimal(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"id":18446744073709551615}')
    schema = T.StructType([T.StructField("id", T.DecimalType(20, 0), False)])
    assert int(next(rows_of(from_ndjson(spark, f"file://{tmp_path}", schema))).id) == 2**64 - 1


def test_runs_can_be_read_again(spark):
    store = RunStore(spark)
    for i in range(3):
        store.store(spark.range(i * 10, i * 10 + 10), sort_by=["id"])
    assert store.fetch(1).count() == store.fetch(1).count() == 10
    assert sorted({r.run_id for r in store.fetch_all().collect()}) == [0, 1, 2]


def test_stored_runs_merge_in_order_and_compact(spark):
    store = RunStore(spark)
    for i in range(3):
        store.store(spark.range(30).where(f"id % 3 = {i}").withColumn("k", F.col("id") % 2), sort_by=["k", "id"])
    merged = [(r.k, r.id, r.run_id) for r in store.merged(["k", "id"]).toLocalIterator()]
    assert merged == sorted((i % 2, i, i % 3) for i in range(30))
    assert (store.rows_out, store.rows_in) == (30, 30)
    fresh = store.compact(["k", "id"], [0, 2])
    assert sorted(r.id for r in store.fetch(fresh).collect()) == [i for i in range(30) if i % 3 != 1]


def test_machines_do_not_share_local_folders():
    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        staging.shared_dir(cluster)


def test_staged_frames_go_when_discarded(spark):
    frame = staging.staged(spark.range(5))
    path = spark._jvm.org.apache.hadoop.fs.Path(frame._staged_at)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert frame.count() == 5 and system.exists(path)
    staging.discard(frame, spark.range(1))
    assert not system.exists(path)


def test_tee_reads_once(spark):
    seen = spark.sparkContext.accumulator(0)
    source = spark.range(20).select(F.udf(lambda i: (seen.add(1), i)[1], "bigint")("id").alias("id"))
    onward, record = tee(source)
    assert onward.where("id < 3").count() == 3 and record.count() == 20 and seen.value == 20


def test_tee_of_a_stream(spark):
    a, b = [], []
    left, _ = streams(spark)
    tee_stream(left, [lambda f, n: a.extend(r.a for r in f.collect()), lambda f, n: b.append((n, f.count()))]).awaitTermination()
    assert sorted(a) == list(range(100)) and sum(n for _, n in b) == 100


def test_counters(spark):
    left, right = spark.range(100).withColumnRenamed("id", "a"), spark.range(50, 150).withColumnRenamed("id", "b")
    got = measure(join(left, right, Predicate.equi("a", "b"), "sort_merge"))
    assert (got["rows_out"], got["rows_shuffled"], got["exchanges"], got["sorts"], got["broadcasts"]) == (50, 200, 2, 2, 0)


KINDS = {
    "progressive": (ProgressiveMerge, {}),
    "xjoin": (XJoin, {"partitions": 3}),
    "xjoin, a probe a stall": (XJoin, {"partitions": 3, "probes": 1}),
    "hash merge": (HashMerge, {"partitions": 4, "mem_parts_per_disk_part": 2, "fan_in": 2, "policy": "smallest"}),
    "hash merge, own policy": (HashMerge, {"partitions": 3, "policy": lambda s: s.orderBy("part").limit(1)}),
}


def keyed(spark, rows, name):
    return spark.createDataFrame([(k, f"{name}{i}") for i, k in rows], f"{name} int, run_id string" if name == "a" else f"{name} int, lt string")


@pytest.mark.parametrize("kind", list(KINDS))
def test_phases_give_every_pair_once(spark, kind):
    lefts = [[(0, 1), (1, 1), (2, 2)], [(3, 1), (4, None)], [], [(5, 2), (6, 1)], [(7, 3)]]
    rights = [[(0, 2)], [(1, 1), (2, 1)], [(3, 3), (4, None)], [(5, 1)]]
    expected = Counter((f"a{i}", f"b{j}") for x in lefts for i, k in x for y in rights for j, m in y if k is not None and k == m)
    make, config = KINDS[kind]
    left, right = ([keyed(spark, x, n) for x in xs] for xs, n in ((lefts, "a"), (rights, "b")))
    op = make(spark, left[0].schema, right[0].schema, Predicate.equi("a", "b"), memory_rows=4, **config)
    assert Counter((r.run_id, r.lt) for r in play(op, left, right, stall_every=2).collect()) == expected
    assert op.results().columns == ["a", "run_id", "b", "lt"] and op.disk[0].rows_out + op.disk[1].rows_out > 0
    assert [p["rows_read"] for p in op.progress] == sorted(p["rows_read"] for p in op.progress)
    assert sum(p["rows_written"] for p in op.progress) == sum(expected.values())


def test_phases_of_empty_sides_swaps_and_maps(spark):
    left, right = keyed(spark, [(0, 1), (1, 2)], "a"), keyed(spark, [(0, 2)], "b")
    make = lambda pred, *schemas: XJoin(spark, *schemas, pred, memory_rows=1, partitions=2)
    pred = Predicate.equi("a", "b")
    assert play(make(pred, left.schema, right.schema), [], [right]).count() == 0
    assert [tuple(r) for r in play(make(pred.swap(), right.schema, left.schema), [right], [left], (1, 2)).collect()] == [(2, "a1", 2, "b0")]
    mapped = Predicate.equi("x", "b").map_left([(F.col("a") + 1).alias("x")]).map([F.col("x"), F.col("lt")])
    assert [tuple(r) for r in play(make(mapped, left.schema, right.schema), [left], [right]).collect()] == [(2, "b0")]


@pytest.mark.parametrize(("make", "config"), [(XJoin, {"memory_rows": 0}), (HashMerge, {"fan_in": 1}), (HashMerge, {"partitions": 4, "mem_parts_per_disk_part": 3})])
def test_phases_refuse_what_cannot_work(spark, make, config):
    schema = [spark.createDataFrame([], f"{n} int").schema for n in "ab"]
    with pytest.raises(ValueError):
        make(spark, *schema, Predicate.equi("a", "b"), **config)
    with pytest.raises(ValueError, match="keys"):
        make(spark, *schema, Predicate.theta(lambda l, r: l("a") < r("b")))


def streams(spark):
    left = spark.range(100).withColumnRenamed("id", "a")
    right = spark.range(50, 150).withColumnRenamed("id", "b")
    return [stream_from_dir(spark, stage_as_stream_source(f), f.schema) for f in (left, right)]


def test_progress_and_state_limit(spark):
    done = run(spark, join(*streams(spark), Predicate.equi("a", "b"), "symmetric_hash"))
    assert done.rows.count() == 50
    curve = progress_curve(done.progress)
    assert curve[-1][0] == 200 and all(x <= y for x, y in zip(curve, curve[1:], strict=False))
    with pytest.raises(StateLimitExceeded, match="the limit is 20"):
        run(spark, join(*streams(spark), Predicate.equi("a", "b"), "symmetric_hash"), max_state_rows=20)


def test_a_stream_has_its_own_settings(spark):
    names = ["spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"]
    before = [spark.conf.get(n) for n in names]
    joined = join(*streams(spark), Predicate.equi("a", "b"), "symmetric_hash")
    for state in (DISK_STATE, HEAP_STATE):
        done = run(spark, joined if state == DISK_STATE else join(*streams(spark), Predicate.equi("a", "b"), "symmetric_hash"), state=state, partitions=2)
        rocks = any("rocksdb" in k.lower() for p in done.progress for o in p["stateOperators"] for k in o["customMetrics"])
        assert rocks == (state == DISK_STATE) and done.progress[-1]["stateOperators"][0]["numShufflePartitions"] == 2
        assert [spark.conf.get(n) for n in names] == before


def test_streams_need_keys(spark):
    with pytest.raises(ValueError, match="keys"):
        join(*streams(spark), Predicate.theta(lambda l, r: l("a") < r("b")), "symmetric_hash")


def test_expected_reads_meet_where_the_small_side_ends():
    assert expected_reads_one_in_ten(5000) == 150_000
