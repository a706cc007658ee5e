"""The contract's queries over the relational tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.predicate import Predicate
from tributary.operators import phases
from tributary.operators.batch import bucket_order_trusted, write_presorted
from tributary.operators.ranking import row_numbers
from tributary.plans import flush
from tributary.plans.api import join, join_in_memory
from tributary.plans.metrics import counted, measure
from tributary.sources.readers import from_concat_json, from_ndjson, stage_as_stream_source, stream_from_dir
from tributary.sources.runs import RunStore
from tributary.sources.staging import fresh_path, staged
from tributary.sources.tee import tee
from tributary.streaming.metrics import phase_curve
from tributary.streaming.phased import HashMerge, Phased, ProgressiveMerge, XJoin, play
from tributary.streaming.progressive import run

Query = Callable[[SparkSession, str], DataFrame]

ORDER_LINES = ("o_orderkey", "o_custkey", "l_linenumber", "l_partkey", "l_quantity")
ORDERKEY = Predicate.equi("o_orderkey", "l_orderkey")
NATION = Predicate.equi("c_nationkey", "n_nationkey")


def _table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "orders", "o_orderkey", "o_custkey")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def _order_lines(strategy: str, pred: Predicate = ORDERKEY) -> Query:
    return lambda s, d: join(_orders(s, d), _lines(s, d), pred, strategy).select(*ORDER_LINES)


def _nations(strategy: str) -> Query:
    return lambda s, d: join(_table(s, d, "customer", "c_custkey", "c_nationkey"), _table(s, d, "nation", "n_nationkey", "n_name"), NATION, strategy).select("c_custkey", "n_name")


def inner_ordered_merge(spark: SparkSession, sf: str) -> DataFrame:
    left = write_presorted(_orders(spark, sf), "tributary_orders", ["o_orderkey"])
    right = write_presorted(_lines(spark, sf), "tributary_lines", ["l_orderkey"])
    with bucket_order_trusted(spark):
        return staged(join(left, right, ORDERKEY, "ordered_merge").select(*ORDER_LINES), "ordered-merge")


def equi_composite_computed(spark: SparkSession, sf: str) -> DataFrame:
    pred = Predicate.equi(["c_nationkey", lambda c: c("c_custkey") % 10], ["s_nationkey", lambda c: (c("s_suppkey") * 2) % 10])
    return join(_table(spark, sf, "customer", "c_custkey", "c_nationkey"), _table(spark, sf, "supplier", "s_suppkey", "s_nationkey"), pred, "simple_hash").select("c_custkey", "s_suppkey")


def equi_null_safe(spark: SparkSession, sf: str) -> DataFrame:
    nulled = lambda c: F.when(F.col(c) >= 5, F.col(c))
    left = _table(spark, sf, "customer", "c_custkey", "c_nationkey").withColumn("c_nationkey", nulled("c_nationkey"))
    right = _table(spark, sf, "supplier", "s_suppkey", "s_nationkey").withColumn("s_nationkey", nulled("s_nationkey"))
    return join(left, right, Predicate.equi("c_nationkey", "s_nationkey", null_safe=True), "sort_merge").select("c_custkey", "s_suppkey")


def equi_heterogeneous(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers against text, some of which is no number."""
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("order "), F.col("l_orderkey"))).otherwise(F.col("l_orderkey").cast("string"))
    return join(_orders(spark, sf), _lines(spark, sf).withColumn("l_order", text), Predicate.equi("o_orderkey", "l_order"), "sort_merge").select(*ORDER_LINES)


def merge_coarse_order(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted by tens, matched by the key."""
    tens = lambda name: lambda c: F.floor(c(name) / 10)
    pred = Predicate.ordered(tens("o_orderkey"), tens("l_orderkey"), lambda l, r: l("o_orderkey") == r("l_orderkey"))
    return join(_orders(spark, sf), _lines(spark, sf), pred, "sort_merge").select(*ORDER_LINES)


def theta_lt(spark: SparkSession, sf: str) -> DataFrame:
    pred = Predicate.theta(lambda l, r: l("n_regionkey") < r("r_regionkey"))
    return join(_table(spark, sf, "nation", "n_nationkey", "n_regionkey"), _table(spark, sf, "region", "r_regionkey"), pred, "nested_loop").select("n_nationkey", "r_regionkey")


def theta_mixed(spark: SparkSession, sf: str) -> DataFrame:
    pred = Predicate.theta(lambda l, r: l("p_retailprice") > r("s_acctbal")).where(lambda l, r: l("p_size") == r("s_nationkey"))
    return join(_table(spark, sf, "part", "p_partkey", "p_size", "p_retailprice"), _table(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal"), pred, "block_nested_loop").select("p_partkey", "s_suppkey")


def theta_interval_self(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    pred = Predicate.equi("user_id").where(lambda l, r: (l("event_type") != r("event_type")) & (r("ts") > l("ts")) & (r("ts") <= l("ts") + F.expr("interval 1 hour")))
    return join(events, events, pred.with_suffixes("_a", "_b"), "sort_merge").select(F.col("event_id_a").alias("first_id"), F.col("event_id_b").alias("second_id"))


def pred_swap(spark: SparkSession, sf: str) -> DataFrame:
    return join(_lines(spark, sf), _orders(spark, sf), ORDERKEY.swap(), "sort_merge").select(*ORDER_LINES)


def pred_map_left(spark: SparkSession, sf: str) -> DataFrame:
    pred = Predicate.equi("doubled", "l_orderkey").map_left([F.col("o_orderkey"), (F.col("o_orderkey") * 2).alias("doubled")])
    return join(_orders(spark, sf), _lines(spark, sf), pred, "simple_hash").select("o_orderkey", "l_orderkey", "l_linenumber")


def pred_map_right(spark: SparkSession, sf: str) -> DataFrame:
    pred = Predicate.equi("o_orderkey", "halved").map_right([F.floor(F.col("l_orderkey") / 2.0).cast("bigint").alias("halved"), F.col("l_orderkey"), F.col("l_linenumber")])
    return join(_orders(spark, sf), _lines(spark, sf), pred, "sort_merge").select("o_orderkey", "l_orderkey", "l_linenumber")


def pred_map_output(spark: SparkSession, sf: str) -> DataFrame:
    pred = ORDERKEY.map([F.concat_ws("-", "o_orderstatus", "l_returnflag").alias("tag"), (F.col("l_linenumber") + 1).alias("n")])
    return join(_table(spark, sf, "orders", "o_orderkey", "o_orderstatus"), _table(spark, sf, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber"), pred, "simple_hash")


def anti_set(spark: SparkSession, sf: str) -> DataFrame:
    return join(_orders(spark, sf), _table(spark, sf, "lineitem", "l_orderkey"), ORDERKEY, "anti")


def anti_set_documents(spark: SparkSession, sf: str) -> DataFrame:
    return join(_table(spark, sf, "documents", "doc_id", "lang"), _table(spark, sf, "labels", "doc_id"), Predicate.equi("doc_id"), "anti")


def _anti_bag(block_rows: int | None) -> Query:
    return lambda s, d: join(_table(s, d, "customer", "c_custkey", "c_nationkey"), _table(s, d, "supplier", "s_nationkey"), Predicate.equi("c_nationkey", "s_nationkey"), "anti", mode="bag", order_by=["c_custkey"], block_rows=block_rows)


def except_all_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The bag anti join on whole rows of keys, which is EXCEPT ALL."""
    return _table(spark, sf, "customer", "c_nationkey").exceptAll(_table(spark, sf, "supplier", "s_nationkey"))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return flush.partition_stats(_table(spark, sf, "orders", "o_orderkey"), F.col("o_orderkey") % 8, _table(spark, sf, "lineitem", "l_orderkey"), F.col("l_orderkey") % 8)


#: The five-partition layout of the adaptive policy's published example, (part, left rows, right rows).
LAYOUT = [(0, 4, 12), (1, 11, 13), (2, 13, 10), (3, 6, 4), (4, 25, 2)]


def _golden(a: int, b: float) -> Query:
    return lambda s, d: flush.flush_adaptive(s.createDataFrame(LAYOUT, "part int, l bigint, r bigint"), a, b)


#: Three partitions at which a ratio, rounded to 32 bits before it is subtracted, decides: (part, left rows, right rows).
BOUND = [(0, 1, 1), (1, 2, 4), (2, 6, 1)]


def flush_adaptive_bound(spark: SparkSession, sf: str) -> DataFrame:
    return flush.flush_adaptive(spark.createDataFrame(BOUND, "part int, l bigint, r bigint"), 2, 0.2)


def _runs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return (_table(spark, sf, "orders", "o_orderkey").withColumn("lrun", F.col("o_orderkey") % 4), _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").withColumn("rrun", F.col("l_partkey") % 4))


PHASE_COLUMNS = ("o_orderkey", "l_linenumber", "l_partkey")


def progressive_early(spark: SparkSession, sf: str) -> DataFrame:
    return phases.early(*_runs(spark, sf), ORDERKEY, "lrun", "rrun").select(*PHASE_COLUMNS)


def progressive_late(spark: SparkSession, sf: str) -> DataFrame:
    return phases.late(*_runs(spark, sf), ORDERKEY, "lrun", "rrun").select(*PHASE_COLUMNS)


def _streamed(strategy: str, **config) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        frames = _orders(spark, sf), _lines(spark, sf)
        sides = [stream_from_dir(spark, stage_as_stream_source(f), f.schema) for f in frames]
        if strategy == "symmetric_hash":
            return run(spark, join(*sides, ORDERKEY, strategy)).rows.select(*ORDER_LINES)
        return join(*sides, ORDERKEY, strategy, memory_rows=_memory(*frames), **config).select(*ORDER_LINES)

    return query


#: Batches in which rows of the phase queries arrive, and partitions of their keys.
BATCHES, PARTS = 4, 8


def _memory(*frames: DataFrame) -> int:
    """A fifth of all rows, so that some have to leave."""
    return max(1, sum(f.count() for f in frames) // 5)


def _phased(kind: type[Phased], stall_every: int | None = None, **config) -> Callable[[SparkSession, str], Phased]:
    """Plays orders by customer against lines by part, batch after batch."""

    @functools.lru_cache(4)  # a query for each phase, one run for all
    def played(spark: SparkSession, sf: str) -> Phased:
        left, right = _orders(spark, sf), _table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
        op = kind(spark, left.schema, right.schema, ORDERKEY.hashed_by("o_orderkey", "l_orderkey"), **({"memory_rows": _memory(left, right)} | config))
        play(op, *([f.where(F.col(c) % BATCHES == i) for i in range(BATCHES)] for f, c in ((left, "o_custkey"), (right, "l_partkey"))), stall_every=stall_every)
        return op

    return played


def _phase(played: Callable[[SparkSession, str], Phased], *phases: str) -> Query:
    return lambda s, d: played(s, d).results(*phases).select(*PHASE_COLUMNS)


PROGRESSIVE = _phased(ProgressiveMerge, memory_rows=1)
XJOIN = _phased(XJoin, stall_every=2, partitions=PARTS)
HASH_MERGE = _phased(HashMerge, stall_every=3, partitions=PARTS, policy="largest", fan_in=2)


def progress_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Rows read and rows written after each batch, with memory for all."""
    rows = _table(spark, sf, "orders").count() + _table(spark, sf, "lineitem").count()
    curve = phase_curve(_phased(HashMerge, partitions=PARTS, memory_rows=rows + 1)(spark, sf).progress)
    return spark.createDataFrame([(i + 1, read, written) for i, (read, written) in enumerate(curve)][:BATCHES], "batch int, rows_read bigint, rows_written bigint")


def strategy_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Rows out and rows shuffled of the keyed strategies."""
    found = [(s, measure(join(_orders(spark, sf), _lines(spark, sf), ORDERKEY, s))) for s in ("sort_merge", "simple_hash")]
    return spark.createDataFrame([(s, m["rows_out"], m["rows_shuffled"]) for s, m in found], "strategy string, rows_out bigint, rows_shuffled bigint")


def predicate_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs that a predicate is asked about: all for an inequality, those of equal keys for an equality."""
    nation, region = _table(spark, sf, "nation", "n_nationkey", "n_regionkey"), _table(spark, sf, "region", "r_regionkey")
    rows = []
    for name, pred, strategy in (("less", Predicate.theta(lambda l, r: l("n_regionkey") < r("r_regionkey")), "nested_loop"), ("equal", Predicate.equi("n_regionkey", "r_regionkey"), "sort_merge")):
        asked, calls = counted(spark, pred)
        rows.append((name, join(nation, region, asked, strategy).count(), calls.value))
    return spark.createDataFrame(rows, "predicate string, rows_out bigint, calls bigint")


def runs_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Four sorted runs of orders merged: each row's run and its place in the merge."""
    store = RunStore(spark)
    for i in range(4):
        store.store(_orders(spark, sf).where(F.col("o_custkey") % 4 == i), ["o_orderkey"])
    return row_numbers(store.merged(["o_orderkey"]), [], [F.col("o_orderkey")], "place").select("place", "run_id", "o_orderkey")


def tee_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """What goes on through a tee, filtered and combined, beside the number of rows recorded."""
    onward, record = tee(_orders(spark, sf))
    kept = join(onward.where("o_orderkey % 2 = 0"), _lines(spark, sf), ORDERKEY, "sort_merge")
    return kept.agg(F.count(F.lit(1)).alias("rows_out")).crossJoin(record.agg(F.count(F.lit(1)).alias("rows_recorded")))


USERS = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType(), False)])
POSTS = T.StructType([T.StructField("post_id", T.LongType(), False), T.StructField("user_id", T.LongType(), False), T.StructField("content", T.StringType(), False)])
USER_POSTS = Predicate.equi("id", "user_id")


def in_memory(spark: SparkSession, sf: str) -> DataFrame:
    users, posts = [(i, "") for i in range(50)], [(i, i // 2, "") for i in range(100)]
    return join_in_memory(spark, users, USERS, posts, POSTS, USER_POSTS).select("id", "post_id")


def json_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_path(spark, "ndjson")
    spark.range(50).select("id", F.lit("").alias("name")).write.json(f"{folder}/users")
    spark.range(100).select(F.col("id").alias("post_id"), F.floor(F.col("id") / 2).alias("user_id"), F.lit("").alias("content")).write.json(f"{folder}/posts")
    return join(from_ndjson(spark, f"{folder}/users", USERS), from_ndjson(spark, f"{folder}/posts", POSTS), USER_POSTS, "simple_hash").select("id", "post_id")


def json_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Values one after another on a line, some over several lines."""
    folder = fresh_path(spark, "concat")
    value = F.to_json(F.struct(F.col("id"), F.lit('}{ \\" ').alias("name")))
    users = spark.range(50).select(F.when(F.col("id") % 3 == 0, F.regexp_replace(value, ":", ":\n")).otherwise(value).alias("v"))
    users.agg(F.concat_ws("", F.collect_list("v"))).coalesce(1).write.text(f"{folder}/users")
    posts = spark.range(100).select(F.to_json(F.struct(F.col("id").alias("post_id"), F.floor(F.col("id") / 2).alias("user_id"), F.lit("").alias("content"))))
    posts.repartition(3).write.text(f"{folder}/posts")
    return join(from_concat_json(spark, f"{folder}/users", USERS), from_concat_json(spark, f"{folder}/posts", POSTS), USER_POSTS, "simple_hash").select("id", "post_id")


QUERIES: dict[str, Query] = {
    "inner_simple_hash": _order_lines("simple_hash"),
    "inner_sort_merge": _order_lines("sort_merge"),
    "inner_nested_loop": _nations("nested_loop"),
    "inner_block_nested_loop": _nations("block_nested_loop"),
    "inner_ordered_merge": inner_ordered_merge,
    "equi_composite_computed": equi_composite_computed,
    "equi_null_safe": equi_null_safe,
    "equi_heterogeneous": equi_heterogeneous,
    "merge_coarse_order": merge_coarse_order,
    "theta_lt": theta_lt,
    "theta_mixed": theta_mixed,
    "theta_interval_self": theta_interval_self,
    "pred_swap": pred_swap,
    "pred_map_left": pred_map_left,
    "pred_map_right": pred_map_right,
    "pred_map_output": pred_map_output,
    "anti_set": anti_set,
    "anti_set_documents": anti_set_documents,
    "anti_bag": _anti_bag(None),
    "anti_bag_blocks_100": _anti_bag(100),
    "except_all_keys": except_all_keys,
    "flush_smallest": lambda s, d: flush.flush_smallest(_stats(s, d)),
    "flush_largest": lambda s, d: flush.flush_largest(_stats(s, d)),
    "flush_adaptive": lambda s, d: flush.flush_adaptive(_stats(s, d), 10, 0.25),
    "flush_adaptive_golden_1": _golden(10, 0.25),
    "flush_adaptive_golden_2": _golden(10, 0.10),
    "flush_adaptive_golden_4": _golden(1, 0.10),
    "flush_adaptive_bound": flush_adaptive_bound,
    "progressive_early": progressive_early,
    "progressive_late": progressive_late,
    "progressive_merge_early": _phase(PROGRESSIVE, "early"),
    "progressive_merge_late": _phase(PROGRESSIVE, "late"),
    "xjoin_stage1": _phase(XJOIN, "early"),
    "xjoin_stage2": _phase(XJOIN, "stage2"),
    "xjoin_stage3": _phase(XJOIN, "stage3"),
    "hash_merge_early": _phase(HASH_MERGE, "early"),
    "hash_merge_late": _phase(HASH_MERGE, "late"),
    "progress_curve": progress_curve,
    "strategy_counters": strategy_counters,
    "predicate_calls": predicate_calls,
    "runs_merged": runs_merged,
    "tee_recorded": tee_recorded,
    "stream_symmetric_hash": _streamed("symmetric_hash"),
    "stream_progressive_merge": _streamed("progressive_merge"),
    "stream_xjoin": _streamed("xjoin", partitions=PARTS),
    "stream_hash_merge": _streamed("hash_merge", partitions=PARTS, policy="smallest"),
    "json_ndjson": json_ndjson,
    "json_concat": json_concat,
    "in_memory": in_memory,
}

_ORDER_LINES = "select o_orderkey, o_custkey, l_linenumber, l_partkey, l_quantity from orders join lineitem on o_orderkey = l_orderkey"
_NATIONS = "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey"
_POSTS = "select u.i id, p.i post_id from range(50) u(i) join range(100) p(i) on u.i = p.i // 2"
_STATS = """select cast(coalesce(a.p, b.p) as int) part, cast(coalesce(l, 0) as bigint) l, cast(coalesce(r, 0) as bigint) r
from (select o_orderkey % 8 p, count(*) l from orders group by 1) a full join (select l_orderkey % 8 p, count(*) r from lineitem group by 1) b on a.p = b.p"""
_LAYOUT, _BOUND = ("select * from (values " + ", ".join(f"({p}, cast({x} as bigint), cast({y} as bigint))" for p, x, y in rows) + ") v(part, l, r)" for rows in (LAYOUT, BOUND))


def _adaptive_sql(stats: str, a: int, b: float) -> str:
    share = lambda x: f"cast(cast({x} as float) / cast(tl + tr as float) as float)"
    even = lambda x, y: f"cast(abs({share(x)} - {share(y)}) as float) < cast({b} as float)"
    return f"""with st as ({stats}), t as (select *, cast(sum(l) over () as bigint) tl, cast(sum(r) over () as bigint) tr from st),
f as (select *, {even("tl", "tr")} bal, {even("tl - l", "tr - r")} keeps,
  l >= {a} and r >= {a} acc, (tl >= tr and l >= r) or (tl < tr and r >= l) heavy from t),
c1 as (select *, bool_or(acc) over () m from f where bal or heavy),
c2 as (select *, bool_or(keeps) over () k from c1 where acc or not m)
select part, l, r from c2 where not bal or not k or keeps order by l + r desc, part desc limit 1"""


def _bag_sql(block: str) -> str:
    return f"""with x as (select c_custkey, c_nationkey, {block} blk from customer),
y as (select *, row_number() over (partition by blk, c_nationkey order by c_custkey) rn, count(*) over (partition by blk, c_nationkey) n from x),
c as (select s_nationkey k, count(*) c from supplier group by 1)
select c_custkey, c_nationkey from y left join c on c_nationkey = k where c is null or (rn >= 2 and rn <= n - c + 1)"""


_ZEROS = "[" + ", ".join(["cast(0 as bigint)"] * PARTS) + "]"
#: Rows by batch and partition, as a list for each batch.
_ARRIVALS = f"""o as (select *, o_custkey % {BATCHES} + 1 t, o_orderkey % {PARTS} p from orders), i as (select *, l_partkey % {BATCHES} + 1 t, l_orderkey % {PARTS} p from lineitem),
m as (select ((select count(*) from orders) + (select count(*) from lineitem)) // 5 m),
b as (select t, list(l order by p) bl, list(r order by p) br from (select x t, y p, (select count(*) from o where o.t = x and o.p = y) l, (select count(*) from i where i.t = x and i.p = y) r
  from range(1, {BATCHES + 1}) f(x), range({PARTS}) g(y)) group by t)"""


def _zip_sum(a: str, b: str) -> str:
    return f"list_transform(range(1, {PARTS + 1}), lambda k: {a}[k] + {b}[k])"


def _without(a: str, k: str) -> str:
    return f"list_transform(range(1, {PARTS + 1}), lambda j: case when j = {k} then 0 else {a}[j] end)"


#: Evictions of the largest partition, both sides together: (t, part). A step takes in a batch or evicts.
_PAIRED = f"""{_ARRIVALS}, z as (select s.n, s.t, s.l, s.r, s.v from (select 0 n, 0 t, {_ZEROS} l, {_ZEROS} r, 0 v) s
union all select n + 1, case when full_ then y.t else y.t + 1 end, case when full_ then {_without("l", "w")} else {_zip_sum("l", "bl")} end, case when full_ then {_without("r", "w")} else {_zip_sum("r", "br")} end, case when full_ then w else 0 end
  from (select z.*, list_sum(l) + list_sum(r) >= m.m full_, list_max(list_transform(range(1, {PARTS + 1}), lambda k: (l[k] + r[k]) * 100 + k)) % 100 w from z, m) y left join b on b.t = y.t + 1 and not full_
  where full_ or b.t is not null),
e as (select t, v - 1 p from z where v > 0),
q as (select o_orderkey, l_linenumber, l_partkey, (select count(*) from e where e.p = o.p and e.t < o.t) a, (select count(*) from e where e.p = i.p and e.t < i.t) c from o join i on o_orderkey = l_orderkey)"""
#: The same with the largest partition of either side, the right one of equals: (t, side, part); and each pair's stage.
_SINGLE = f"""{_ARRIVALS}, z as (select s.n, s.t, s.l, s.r, s.v from (select 0 n, 0 t, {_ZEROS} l, {_ZEROS} r, cast(0 as bigint) v) s
union all select n + 1, case when full_ then y.t else y.t + 1 end, case when full_ then {_without("l", "w")} else {_zip_sum("l", "bl")} end, case when full_ then {_without("r", "w - 100")} else {_zip_sum("r", "br")} end, case when full_ then w else 0 end
  from (select z.*, list_sum(l) + list_sum(r) >= m.m full_, list_max(list_transform(range(1, {PARTS + 1}), lambda k: greatest(l[k] * 1000 + k, r[k] * 1000 + 100 + k))) % 1000 w from z, m) y left join b on b.t = y.t + 1 and not full_
  where full_ or b.t is not null),
e as (select t, v // 100 s, v % 100 - 1 p from z where v > 0),
q as (select o_orderkey, l_linenumber, l_partkey, o.t lt, i.t rt, coalesce((select min(t) from e where s = 0 and e.p = o.p and e.t >= o.t), 99) lo, coalesce((select min(t) from e where s = 1 and e.p = i.p and e.t >= i.t), 99) ro
  from o join i on o_orderkey = l_orderkey),
g as (select *, case when greatest(lt, rt) <= least(lo, ro) then 1
  when list_bool_or(list_transform([2, 4], lambda s: (lo <= s and rt <= s and ro > s) or (ro <= s and lt <= s and lo > s))) then 2 else 3 end stage from q)"""


def _phase_sql(steps: str, source: str, where: str) -> str:
    return f"with recursive {steps} select o_orderkey, l_linenumber, l_partkey from {source} where {where}"


ORACLES: dict[str, str] = {
    **{f"xjoin_stage{k}": _phase_sql(_SINGLE, "g", f"stage = {k}") for k in (1, 2, 3)},
    "hash_merge_early": _phase_sql(_PAIRED, "q", "a = c"),
    "hash_merge_late": _phase_sql(_PAIRED, "q", "a <> c"),
    **{f"progressive_merge_{name}": f"select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey where o_custkey % {BATCHES} {op} l_partkey % {BATCHES}" for name, op in (("early", "="), ("late", "<>"))},
    "progress_curve": f"""select cast(k as int) batch, (select count(*) from orders where o_custkey % {BATCHES} < k) + (select count(*) from lineitem where l_partkey % {BATCHES} < k) rows_read,
  (select count(*) from orders join lineitem on o_orderkey = l_orderkey where greatest(o_custkey % {BATCHES}, l_partkey % {BATCHES}) < k) rows_written from range(1, {BATCHES + 1}) f(k)""",
    "strategy_counters": "select s strategy, (select count(*) from orders join lineitem on o_orderkey = l_orderkey) rows_out, (select count(*) from orders) + (select count(*) from lineitem) rows_shuffled from (values ('sort_merge'), ('simple_hash')) v(s)",
    "predicate_calls": """select 'less' predicate, count(*) filter (n_regionkey < r_regionkey) rows_out, count(*) calls from nation, region
union all select 'equal', count(*), count(*) from nation join region on n_regionkey = r_regionkey""",
    "runs_merged": "select row_number() over (order by o_orderkey) place, cast(o_custkey % 4 as int) run_id, o_orderkey from orders",
    "tee_recorded": "select (select count(*) from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 2 = 0) rows_out, (select count(*) from orders) rows_recorded",
    "equi_heterogeneous": "select o_orderkey, o_custkey, l_linenumber, l_partkey, l_quantity from orders join lineitem on o_orderkey = try_cast(case when l_linenumber = 1 then 'order ' || l_orderkey else cast(l_orderkey as varchar) end as bigint)",
    "flush_adaptive_bound": _adaptive_sql(_BOUND, 2, 0.2),
    **dict.fromkeys(("inner_simple_hash", "inner_sort_merge", "inner_ordered_merge", "merge_coarse_order", "pred_swap", "stream_symmetric_hash", "stream_progressive_merge", "stream_xjoin", "stream_hash_merge"), _ORDER_LINES),
    **dict.fromkeys(("inner_nested_loop", "inner_block_nested_loop"), _NATIONS),
    "equi_composite_computed": "select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey and c_custkey % 10 = (s_suppkey * 2) % 10",
    "equi_null_safe": "select c_custkey, s_suppkey from customer join supplier on (case when c_nationkey >= 5 then c_nationkey end) is not distinct from (case when s_nationkey >= 5 then s_nationkey end)",
    "theta_lt": "select n_nationkey, r_regionkey from nation join region on n_regionkey < r_regionkey",
    "theta_mixed": "select p_partkey, s_suppkey from part join supplier on p_retailprice > s_acctbal and p_size = s_nationkey",
    "theta_interval_self": "select a.event_id first_id, b.event_id second_id from events a join events b on a.user_id = b.user_id and a.event_type <> b.event_type and b.ts > a.ts and b.ts <= a.ts + interval 1 hour",
    "pred_map_left": "select o_orderkey, l_orderkey, l_linenumber from orders join lineitem on o_orderkey * 2 = l_orderkey",
    "pred_map_right": "select o_orderkey, l_orderkey, l_linenumber from orders join lineitem on o_orderkey = cast(floor(l_orderkey / 2.0) as bigint)",
    "pred_map_output": "select o_orderstatus || '-' || l_returnflag tag, l_linenumber + 1 n from orders join lineitem on o_orderkey = l_orderkey",
    "anti_set": "select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "anti_set_documents": "select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)",
    "anti_bag": _bag_sql("0"),
    "anti_bag_blocks_100": _bag_sql("(row_number() over (order by c_custkey) - 1) // 100"),
    "except_all_keys": "select c_nationkey from customer except all select s_nationkey from supplier",
    "flush_smallest": f"select * from ({_STATS}) where l + r > 0 order by l + r, part limit 1",
    "flush_largest": f"select * from ({_STATS}) order by l + r desc, part desc limit 1",
    "flush_adaptive": _adaptive_sql(_STATS, 10, 0.25),
    "flush_adaptive_golden_1": _adaptive_sql(_LAYOUT, 10, 0.25),
    "flush_adaptive_golden_2": _adaptive_sql(_LAYOUT, 10, 0.10),
    "flush_adaptive_golden_4": _adaptive_sql(_LAYOUT, 1, 0.10),
    "progressive_early": "select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 4 = l_partkey % 4",
    "progressive_late": "select o_orderkey, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 4 <> l_partkey % 4",
    "json_ndjson": _POSTS,
    "json_concat": _POSTS,
    "in_memory": _POSTS,
}
