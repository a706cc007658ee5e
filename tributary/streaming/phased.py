"""Progressive strategies that keep explicit runs: rows arrive in batches, results leave in phases, and the phases together are the
complete inner join, each pair once.

Batches are numbered by a logical clock and written once, by partition of the key's hash. "Memory" is what no eviction has
covered yet, at most `memory_rows` rows of both sides after each batch; what is evicted becomes a run in a RunStore. Which pairs have
met follows from batch numbers, eviction times and run numbers alone, so every phase is one relational join with a
condition on these, and Spark plans, spills and splits it. The driver holds numbers for each partition and run, no rows.

=================  ======================================================  =================================================
strategy           early                                                   later
=================  ======================================================  =================================================
ProgressiveMerge   the two buffers of a run, as it is flushed              all runs merged, pairs of one run left out
XJoin              a batch against what is resident                        stalled: disk against memory; then all that never met
HashMerge          a batch against what is resident                        stalled or at the end: up to `fan_in` runs merged
=================  ======================================================  =================================================

Null keys match nothing unless the predicate is null-safe. Empty batches and empty sides are allowed. Zero limits raise.
"""

from __future__ import annotations

import time
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.names import free_names
from tributary.functions.predicate import Predicate, project
from tributary.plans.flush import POLICIES
from tributary.sources.runs import RunStore
from tributary.sources.staging import fresh_path

MEMORY_ROWS, PARTITIONS, FAN_IN = 50_000_000, 64, 256
#: The eviction time of a row that was never evicted.
NEVER = (1 << 62) - 1


def _look_up(numbers: dict[int, int], key: Column, default: int) -> Column:
    """A number for each partition, as a column."""
    if not numbers:
        return F.lit(default).cast("bigint")
    known = F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair))
    return F.coalesce(known[key], F.lit(default)).cast("bigint")


class Phased:
    """What the strategies share: arrival, residency and emission."""

    def __init__(self, spark: SparkSession, left: T.StructType, right: T.StructType, pred: Predicate, memory_rows: int = MEMORY_ROWS, partitions: int = PARTITIONS):
        if memory_rows <= 0 or partitions <= 0:
            raise ValueError("memory_rows and partitions must be positive")
        if not pred.has_keys:
            raise ValueError("progressive strategies need equality keys")
        self.spark, self.pred, self.memory_rows, self.parts = spark, pred, memory_rows, partitions
        self.core = replace(pred, left_maps=(), right_maps=(), output=(), swapped=False)
        self.maps = (pred.left_maps, pred.right_maps)
        given = [spark.createDataFrame([], s) for s in ((right, left) if pred.swapped else (left, right))]
        self.empty = [reduce(project, m, g) for m, g in zip(self.maps, given, strict=True)]
        taken = [c for e in self.empty for c in e.columns]
        names = free_names(taken, "lt", "lp", "lo", "rt", "rp", "ro")
        self.t, self.p, self.o = (names[0], names[3]), (names[1], names[4]), (names[2], names[5])
        self.part = self.core.partitions(*self.empty, partitions)
        self.arrived = (RunStore(spark), RunStore(spark))
        self.disk = (RunStore(spark), RunStore(spark))
        self.clock = 0
        self.batch_parts: tuple[dict[int, Counter], dict[int, Counter]] = ({}, {})  # clock -> rows by partition
        self.batch_run: tuple[dict[int, int], dict[int, int]] = ({}, {})
        self.evicted: tuple[dict[int, int], dict[int, int]] = ({}, {})  # partition -> clock of its last eviction
        self.held = (Counter(), Counter())
        self.rows_read = 0
        self.written: dict[str, list[str]] = defaultdict(list)
        self.progress: list[dict] = []
        self.schema = self._match(*(self._tagged(e, s) for s, e in enumerate(self.empty)), None).schema
        self.out = fresh_path(spark, "phases")

    # arrival and residency

    def _tagged(self, frame: DataFrame, side: int) -> DataFrame:
        alias = "lr"[side]
        return frame.alias(alias).select(f"{alias}.*", F.lit(self.clock).cast("bigint").alias(self.t[side]), self.part[side].alias(self.p[side]), F.lit(NEVER).alias(self.o[side]))

    def add(self, left: DataFrame | None, right: DataFrame | None) -> None:
        """One batch of each side, or none."""
        self.clock += 1
        for side, frame in enumerate((right, left) if self.pred.swapped else (left, right)):
            if frame is None:
                continue
            frame = reduce(project, self.maps[side], frame)
            run = self.arrived[side].store(self._tagged(frame, side), [self.p[side]])
            counts = self.arrived[side].fetch(run).groupBy(self.p[side]).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
            self.batch_run[side][self.clock] = run
            self.batch_parts[side][self.clock] = Counter({r[0]: r[1] for r in counts})
            self.held[side].update(self.batch_parts[side][self.clock])
            self.rows_read += self.arrived[side].sizes[run]
        self._arrive()
        if self._rows_held() >= self.memory_rows:
            self._make_room()

    def _rows_held(self) -> int:
        return sum(self.held[0].values()) + sum(self.held[1].values())

    def _batches(self, side: int, clocks: Iterable[int]) -> DataFrame:
        runs = [self.batch_run[side][c] for c in clocks if c in self.batch_run[side]]
        if not runs:
            return self._tagged(self.empty[side], side)
        return self.arrived[side].rows(runs)

    def _resident(self, side: int, before: int | None = None, parts: Iterable[int] | None = None) -> DataFrame:
        """Rows in memory, optionally only those of earlier batches or of some partitions. Batches without any are not read."""
        gone, wanted = self.evicted[side], None if parts is None else set(parts)
        clocks = [c for c, counts in self.batch_parts[side].items() if (before is None or c < before) and any(gone.get(p, 0) < c and (wanted is None or p in wanted) for p in counts)]
        rows = self._batches(side, clocks).where(F.col(self.t[side]) > _look_up(gone, F.col(self.p[side]), 0))
        return rows if wanted is None else rows.where(F.col(self.p[side]).isin(sorted(wanted)))

    def _forget(self, side: int, parts: Iterable[int]) -> None:
        for p in parts:
            self.evicted[side][p] = self.clock
            self.held[side].pop(p, None)

    def _by_key(self, rows: DataFrame, side: int) -> DataFrame:
        """Sorted, file by file, as a run is stored."""
        alias = "lr"[side]
        return rows.alias(alias).sortWithinPartitions(*(pair[side] for pair in self.core.key_pairs()))

    # matching and emission

    def _match(self, left: DataFrame, right: DataFrame, condition: Column | None) -> DataFrame:
        pred = self.core if condition is None else self.core.where(lambda l, r: condition)
        b = pred.bind(left, right)
        joined = b.finish(b.first.join(b.second, b.condition)).drop(*self.t, *self.p, *self.o)
        return reduce(project, self.pred.output, joined)

    def _emit(self, phase: str, rows: DataFrame) -> None:
        began = time.perf_counter()
        path = f"{self.out}/{phase}/{len(self.progress)}"
        rows.write.parquet(path)
        self.written[phase].append(path)
        stored, fetched = sum(d.rows_out for d in self.disk), sum(d.rows_in for d in self.disk)
        n = self.spark.read.schema(self.schema).parquet(path).count()
        self.progress.append({"phase": phase, "rows_read": self.rows_read, "rows_written": n, "rows_stored": stored, "rows_fetched": fetched, "seconds": round(time.perf_counter() - began, 3)})

    def results(self, *phases: str) -> DataFrame:
        """What has been written so far, of all phases or of some."""
        paths = [p for phase, ps in self.written.items() if not phases or phase in phases for p in ps]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _early(self) -> None:
        """The newest batch against what is resident, and against itself."""
        fresh = [self._batches(s, [self.clock]) for s in (0, 1)]
        if not self.batch_parts[0].get(self.clock) and not self.batch_parts[1].get(self.clock):
            return
        old = [self._resident(s, before=self.clock) for s in (0, 1)]
        met = [self._match(fresh[0], fresh[1].unionByName(old[1]), None)] if self.batch_parts[0].get(self.clock) else []
        met += [self._match(old[0], fresh[1], None)] if self.batch_parts[1].get(self.clock) else []
        self._emit("early", reduce(DataFrame.unionByName, met))

    # what the strategies define

    def _arrive(self) -> None:
        raise NotImplementedError

    def _make_room(self) -> None:
        """Evicts until fewer than `memory_rows` rows are held."""
        raise NotImplementedError

    def stalled(self) -> None:
        """The inputs have nothing at the moment."""

    def finish(self) -> DataFrame:
        """The inputs have ended; all results."""
        raise NotImplementedError


class ProgressiveMerge(Phased):
    """Buffers both sides; full buffers are matched, then become a pair of sorted runs of one number. At the end all runs are merged, and
    pairs of equal run numbers, which have met, are left out."""

    def __init__(self, spark: SparkSession, left: T.StructType, right: T.StructType, pred: Predicate, memory_rows: int = MEMORY_ROWS):
        super().__init__(spark, left, right, pred, memory_rows, 1)
        self.runs = 0

    def _arrive(self) -> None:
        pass

    def _make_room(self) -> None:
        buffers = [self._resident(s) for s in (0, 1)]
        self._emit("early", self._match(*buffers, None))
        for s in (0, 1):
            self.disk[s].store(self._by_key(buffers[s].withColumn(self.t[s], F.lit(self.runs).cast("bigint")), s))
            self._forget(s, [0])
        self.runs += 1

    def finish(self) -> DataFrame:
        if self._rows_held():
            self._make_room()
        if self.runs > 1:
            left, right = (d.rows(range(d.runs)) for d in self.disk)
            self._emit("late", self._match(left, right, F.col(f"l.{self.t[0]}") != F.col(f"r.{self.t[1]}")))
        return self.results()


class XJoin(Phased):
    """Hash partitions of each side, evicted one by one; rows carry when they came and went.

    Stage 1 matches arrivals with what is in memory. Stage 2, while inputs stall, matches partitions on disk with the other
    side's memory, `probes` of them a call, round robin. Stage 3 matches all that is left. Two rows met in stage 1 if they were resident
    together; in stage 2 if a probe found one on disk and the other in memory.
    """

    def __init__(self, spark: SparkSession, left: T.StructType, right: T.StructType, pred: Predicate, memory_rows: int = MEMORY_ROWS, partitions: int = PARTITIONS, probes: int | None = None):
        super().__init__(spark, left, right, pred, memory_rows, partitions)
        if probes is not None and probes <= 0:
            raise ValueError("probes must be positive")
        self.probes, self.cursor = probes or 2 * partitions, 0
        self.runs_of: tuple[dict[int, list[int]], dict[int, list[int]]] = (defaultdict(list), defaultdict(list))
        self.probed: tuple[dict[int, list[int]], dict[int, list[int]]] = (defaultdict(list), defaultdict(list))  # times

    def _arrive(self) -> None:
        self._early()

    def _make_room(self) -> None:
        """Takes the largest partition of either side, again and again: the last of a side's equals, and the right side's where both
        sides' are equal. What goes makes one run a side."""
        victims: tuple[list[int], list[int]] = ([], [])
        while self._rows_held() >= self.memory_rows:
            _, side, p = max((n, side, p) for side in (0, 1) for p, n in self.held[side].items())
            victims[side].append(p)
            self.held[side].pop(p)
        for side in (0, 1):
            if victims[side]:
                rows = self._resident(side, parts=victims[side]).withColumn(self.o[side], F.lit(self.clock).cast("bigint"))
                run = self.disk[side].store(rows, [self.p[side]])
                for p in victims[side]:
                    self.runs_of[side][p].append(run)
                self._forget(side, victims[side])

    def stalled(self) -> None:
        chosen: tuple[dict[int, int], dict[int, int]] = ({}, {})  # partition -> time of its last probe
        for _ in range(min(self.probes, 2 * self.parts)):
            side, p = divmod(self.cursor % (2 * self.parts), self.parts)
            self.cursor += 1
            other = 1 - side
            if not self.runs_of[side].get(p) or not self.held[other].get(p):
                continue
            last = max(self.probed[side][p], default=0)
            newest = max(c for c, counts in self.batch_parts[other].items() if p in counts)
            self.probed[side][p].append(self.clock)
            if newest > last:  # else nothing has come since
                chosen[side][p] = last
        met = []
        for side, parts in enumerate(chosen):
            if parts:
                other, frames = 1 - side, [None, None]
                runs = sorted({r for p in parts for r in self.runs_of[side][p]})
                frames[side] = self.disk[side].rows(runs).where(F.col(self.p[side]).isin(sorted(parts)))
                frames[other] = self._resident(other, parts=parts)
                came, went, part = F.col(f"{'lr'[other]}.{self.t[other]}"), F.col(f"{'lr'[side]}.{self.o[side]}"), F.col(f"{'lr'[side]}.{self.p[side]}")
                met.append(self._match(*frames, came > F.greatest(went, _look_up(parts, part, 0))))
        if met:
            self._emit("stage2", reduce(DataFrame.unionByName, met))

    def _probed(self, side: int) -> Column:
        """Whether a probe of this side's disk found a pair."""
        other, a, b = 1 - side, "lr"[side], "lr"[1 - side]
        times = {p: t for p, t in self.probed[side].items() if t}
        if not times:
            return F.lit(False)
        known = F.create_map(*(x for p, t in times.items() for x in (F.lit(p), F.array(*(F.lit(v).cast("bigint") for v in t)))))
        went, came, left = F.col(f"{a}.{self.o[side]}"), F.col(f"{b}.{self.t[other]}"), F.col(f"{b}.{self.o[other]}")
        return F.coalesce(F.exists(known[F.col(f"{a}.{self.p[side]}")], lambda at: (went <= at) & (came <= at) & (left > at)), F.lit(False))

    def finish(self) -> DataFrame:
        if self.disk[0].runs or self.disk[1].runs:
            both = []
            for s in (0, 1):
                memory = self._resident(s)
                both.append(memory.unionByName(self.disk[s].rows(range(self.disk[s].runs))) if self.disk[s].runs else memory)
            together = F.greatest(F.col(f"l.{self.t[0]}"), F.col(f"r.{self.t[1]}")) <= F.least(F.col(f"l.{self.o[0]}"), F.col(f"r.{self.o[1]}"))
            self._emit("stage3", self._match(*both, ~together & ~self._probed(0) & ~self._probed(1)))
        return self.results()


class HashMerge(Phased):
    """Hash partitions of both sides, evicted in pairs, as sorted runs of one number, by a policy; runs are merged while
    inputs stall and at the end.

    `mem_parts_per_disk_part` partitions share one on disk, which is the policy's unit. A merge takes up to `fan_in` runs of the disk
    partition that has most; merged runs are written back as one while more may come, so no pair is lost whatever the fan-in.
    `policy` is a name in tributary.plans.flush.POLICIES or a function like those; it sees the partitions that hold rows.
    """

    def __init__(self, spark: SparkSession, left: T.StructType, right: T.StructType, pred: Predicate, memory_rows: int = MEMORY_ROWS, partitions: int = PARTITIONS,
                 mem_parts_per_disk_part: int = 1, fan_in: int = FAN_IN, policy: str | Callable[[DataFrame], DataFrame] = "adaptive"):
        super().__init__(spark, left, right, pred, memory_rows, partitions)
        if mem_parts_per_disk_part <= 0 or partitions % mem_parts_per_disk_part:
            raise ValueError("mem_parts_per_disk_part must divide partitions")
        if fan_in < 2:
            raise ValueError("fan_in must be two at least")
        self.width, self.fan_in = mem_parts_per_disk_part, fan_in
        chosen = POLICIES[policy] if isinstance(policy, str) else policy
        self.policy = (lambda s: chosen(s, 10, 0.25)) if policy == "adaptive" else chosen
        self.runs_of: dict[int, list[int]] = defaultdict(list)  # disk partition -> its runs, which have one number on both sides

    def _arrive(self) -> None:
        self._early()

    def _stats(self) -> list[tuple[int, int, int]]:
        """(disk partition, left rows, right rows) of those that hold rows."""
        sums: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for side in (0, 1):
            for p, n in self.held[side].items():
                sums[p // self.width][side] += n
        return [(p, *n) for p, n in sorted(sums.items()) if sum(n)]

    def _members(self, disk_parts: Iterable[int]) -> list[int]:
        return [p for d in disk_parts for p in range(d * self.width, (d + 1) * self.width)]

    def _make_room(self) -> None:
        victims = []
        while self._rows_held() >= self.memory_rows:
            stats = self.spark.createDataFrame(self._stats(), "part int, l bigint, r bigint")
            victims.append(self.policy(stats).first()["part"])
            for p in self._members(victims[-1:]):
                self.held[0].pop(p, None)
                self.held[1].pop(p, None)
        self._evict(victims)

    def _evict(self, disk_parts: list[int]) -> None:
        """Rows of these go out as one pair of sorted runs."""
        members = self._members(disk_parts)
        self._store(disk_parts, [self._resident(s, parts=members) for s in (0, 1)])
        for s in (0, 1):
            self._forget(s, members)

    def _store(self, disk_parts: Iterable[int], sides: list[DataFrame]) -> None:
        run = self.disk[0].runs
        for s in (0, 1):
            self.disk[s].store(self._by_key(sides[s].withColumn(self.t[s], F.lit(run).cast("bigint")), s))
        for d in disk_parts:
            self.runs_of[d].append(run)

    def _on_disk(self, side: int, chosen: dict[int, list[int]]) -> DataFrame:
        """Rows of these runs of these disk partitions."""
        runs = F.create_map(*(x for d, rs in chosen.items() for x in (F.lit(d), F.array(*(F.lit(r).cast("bigint") for r in rs)))))
        part = F.floor(F.col(self.p[side]) / self.width).cast("int")
        return self.disk[side].rows(sorted({r for rs in chosen.values() for r in rs})).where(F.array_contains(runs[part], F.col(self.t[side])))

    def _merge(self, chosen: dict[int, list[int]], write_back: Callable[[int], bool]) -> None:
        """One join of these runs; those of a disk partition become one run where they are still needed."""
        self._emit("late", self._match(*(self._on_disk(s, chosen) for s in (0, 1)), F.col(f"l.{self.t[0]}") != F.col(f"r.{self.t[1]}")))
        for d, runs in chosen.items():
            self.runs_of[d] = self.runs_of[d][len(runs) :]
        again = {d: runs for d, runs in chosen.items() if write_back(d)}
        if again:
            self._store(again, [self._on_disk(s, again) for s in (0, 1)])
        used = {r for runs in self.runs_of.values() for r in runs}
        for s in (0, 1):
            self.disk[s].delete({r for runs in chosen.values() for r in runs} - used)

    def stalled(self) -> None:
        most, d = max(((len(runs), d) for d, runs in self.runs_of.items()), default=(0, 0))
        if most > 1:
            self._merge({d: self.runs_of[d][: self.fan_in]}, lambda d: True)

    def finish(self) -> DataFrame:
        left = [d for d, *_ in self._stats()]
        if left:
            self._evict(left)
        while chosen := {d: runs[: self.fan_in] for d, runs in self.runs_of.items() if len(runs) > 1}:
            self._merge(chosen, lambda d: bool(self.runs_of[d]))
        return self.results()


def play(op: Phased, left: Iterable[DataFrame], right: Iterable[DataFrame], ratio: tuple[int, int] = (1, 1), stall_every: int | None = None) -> DataFrame:
    """Feeds batches, `ratio` of each side a step, with a stall after every `stall_every` steps, and finishes."""
    if min(ratio) < 0 or not max(ratio):
        raise ValueError("ratio must take batches of one side at least")
    sides: list[Iterator[DataFrame]] = [iter(left), iter(right)]
    step = 0
    while True:
        taken = [list(islice(s, k)) for s, k in zip(sides, ratio, strict=True)]
        if not any(taken):
            # a side that the ratio leaves out, or that is longer, comes at its own pace
            taken = [list(islice(s, 1)) for s in sides]
            if not any(taken):
                return op.finish()
        op.add(*(reduce(DataFrame.unionByName, t) if t else None for t in taken))
        step += 1
        if stall_every and step % stall_every == 0:
            op.stalled()


def play_streams(op: Phased, left: DataFrame, right: DataFrame) -> DataFrame:
    """Feeds two streams until their input ends for now, a micro-batch a step, and finishes. Both are read by one query, as a union of
    tagged rows; a micro-batch that is run again is told by its number."""
    if not (left.isStreaming and right.isStreaming):
        raise ValueError("both sides must be streams")
    null = lambda side: F.lit(None).cast(side.schema)
    both = left.select(F.struct("*").alias("l"), null(right).alias("r")).union(right.select(null(left).alias("l"), F.struct("*").alias("r")))
    done: set[int] = set()

    def step(batch: DataFrame, number: int) -> None:
        if number not in done:
            op.add(batch.where("l is not null").select("l.*"), batch.where("r is not null").select("r.*"))
            done.add(number)

    query = both.writeStream.foreachBatch(step).option("checkpointLocation", fresh_path(op.spark, "phased-state")).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return op.finish()


def _strategy(kind: type[Phased]) -> Callable[..., DataFrame]:
    def strategy(left: DataFrame, right: DataFrame, pred: Predicate, **config) -> DataFrame:
        op = kind(left.sparkSession, left.schema, right.schema, pred, **config)
        return play_streams(op, left, right) if left.isStreaming or right.isStreaming else play(op, [left], [right])

    strategy.__doc__ = f"All results of {kind.__name__} over two streams' available input, or over two frames as one batch; written when it returns."
    return strategy


progressive_merge, xjoin, hash_merge = _strategy(ProgressiveMerge), _strategy(XJoin), _strategy(HashMerge)
