"""Exact removal of repeated passages: every byte covered by a string of `LENGTH` bytes that starts anywhere else, too.

1. Each text gives its anchors: of every window of LENGTH bytes, the K-gram with the smallest hash. Equal windows have the
   same anchor at the same place, so a repeat always shows as an anchor that occurs twice. Anchors are counted by fingerprint, summed
   before they are dealt; those that occur in one place fall away.
2. Texts cut out the context of each anchor that is left: what windows around it can hold. Contexts are dealt by
   fingerprint. In a group, the strings to the right of the anchor and those to the left, read backwards, are put in suffix
   order by deep-shallow sorting. Neighbours' common prefixes give, for each offset of the anchor in a window, which members'
   left and right parts agree; members alike in both are repeats, and give covered intervals.
3. A group of an anchor met more than `LIMIT` times does not go to one task. Equal contexts become one member. Groups of more
   than `PART` are parted by what windows share: all windows in which the anchor stands at some of `STEPS` neighbouring offsets have a common core, so
   members that share one of them share the core's hash; those alike in all that such windows see become one again. Parts that
   fit are sorted as in 2. Members of others are put in order over all tasks, by their left and by their right parts. Neighbours' common
   prefixes bound the offsets at which a member can be a repeat, and what a member shares with some neighbours on both sides is a repeat.
   Where these leave offsets open, members that may hold such windows are parted by fewer offsets, in the end by one; then a part is one
   string, a repeat if there are two.
4. Each text merges its intervals and is cut.

Texts that are equal as a whole are read once; they are repeats of each other throughout. Whole texts, and places of an anchor, are told apart
by 64-bit hashes, equal strings of large groups by 128-bit hashes; all else compares bytes.

Cases: null text counts as empty; texts under LENGTH bytes lose nothing; positions are bytes of UTF-8 and may cut a
character; overlaps, also with itself, count; rows that repeat are copies of each other. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.cache import small_batches
from tributary.llm.order_minhash import mixed
from tributary.llm.suffix_sort import common_prefix, deep_shallow_sort
from tributary.sources.staging import discard, staged

LENGTH, K = 400, 64
#: Places of an anchor that may go to one task, members of a part that may, numbers of offsets that share a core, level by level, and
#: salts over which a hot key is spread.
LIMIT, PART, STEPS, SALTS = 4096, 512, (48, 7), 64
#: Windows hashed at a time, rows of positions or intervals that may go to every task, and hot anchors that may.
CHUNK, BROADCAST_ROWS, CROWDS = 1 << 19, 3_000_000, 1_000_000
#: Neighbours on each side in order that a member of a hot part is compared with, and cores asked for that may go to every task.
NEAR, ASKED = 4, 1_000_000
_U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


class Powers:
    """Powers of the multiplier and of its inverse, as many as were needed so far."""

    up = down = np.ones(1, "u8")

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            cls.up = np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, BASE, "u8"))])
            cls.down = np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, INVERSE, "u8"))])
        return cls.up, cls.down


def _anchors(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the smallest k-grams of all windows, the leftmost of equals."""
    up, down = Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(data * down[: len(data)], out=sums[1:])
    grams = len(data) - k + 1
    hashes = mixed((sums[k:] - sums[:-k]) * up[:grams])
    low = _U((1 << 20) - 1)
    ranked = (hashes & ~low) | np.arange(grams, dtype="u8")
    w = length - k + 1
    rows = -(-grams // w)
    padded = np.full(rows * w, np.iinfo("u8").max, "u8")
    padded[:grams] = ranked
    padded = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    places = (np.minimum(behind[: grams - w + 1], ahead[w - 1 : grams]) & low).astype("i8")
    places = places[np.concatenate([[True], places[1:] != places[:-1]])]
    return places, hashes[places]


def anchors(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """As _anchors, chunk by chunk."""
    whole = np.frombuffer(data, "u1")
    found = [(at, _anchors(whole[at : at + CHUNK + length - 1].astype("u8"), length, k)) for at in range(0, len(whole) - length + 1, CHUNK)]
    if not found:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    places, first = np.unique(np.concatenate([p + at for at, (p, _) in found]), return_index=True)
    return places, np.concatenate([h for _, (_, h) in found])[first]


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (begin, end) rows; runs that touch are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    starts = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(starts)
    return np.column_stack([spans[first, 0], reach[np.concatenate([first[1:] - 1, [len(spans) - 1]])]])


def repeated_offsets(members: list[tuple[bytes, bytes, int]], length: int = LENGTH, k: int = K) -> list[list[tuple[int, int]]]:
    """For distinct (left context backwards, right context from the anchor on, number of places) that share an anchor: the ranges of
    offsets (first, last) at which the window around the anchor occurs in another place."""
    lefts, rights = {}, {}
    left = np.array([lefts.setdefault(m[0], len(lefts)) for m in members])
    right = np.array([rights.setdefault(m[1], len(rights)) for m in members])
    many = np.array([m[2] for m in members])
    room_l, room_r = np.array([len(m[0]) for m in members]), np.array([len(m[1]) for m in members])

    def ranked(strings: dict[bytes, int], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order, parts = deep_shallow_sort(list(strings), depth)
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        parts = np.array([*parts, 0])
        return place, parts[:-1], np.maximum(parts[:-1], parts[1:])  # place in order, part from the one before, longest common prefix

    place_l, part_l, near_l = ranked(lefts, 0)
    place_r, part_r, near_r = ranked(rights, k)
    at_l, at_r = place_l[left], place_r[right]
    # a string that several members or places have agrees with them whole
    times_l, times_r = np.bincount(left, many)[left], np.bincount(right, many)[right]
    best_l = np.where(times_l > 1, room_l, near_l[at_l])
    best_r = np.where(times_r > 1, room_r, near_r[at_r])
    out: list[list[tuple[int, int]]] = [[] for _ in members]
    alive = np.flatnonzero(best_l + best_r >= length)
    if not len(alive):
        return out
    last = length - k
    cuts = np.concatenate([[0], length - best_r[alive], length - room_r[alive], length - part_r, part_l + 1, room_l[alive] + 1, best_l[alive] + 1, [last + 1]])
    cuts = np.unique(np.clip(cuts, 0, last + 1))
    at_l, at_r, room_l, room_r, many = at_l[alive], at_r[alive], room_l[alive], room_r[alive], many[alive]
    for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        # between cuts nothing changes: all offsets in [begin, end) behave as the first
        fits = (room_l >= begin) & (room_r >= length - begin)
        if not fits.any():
            continue
        class_l, class_r = np.cumsum(part_l < begin), np.cumsum(part_r < length - begin)
        both = class_l[at_l[fits]] * (len(class_r) + 1) + class_r[at_r[fits]]
        _, which = np.unique(both, return_inverse=True)
        repeats = np.bincount(which, many[fits])[which] > 1
        for m in alive[np.flatnonzero(fits)[repeats]].tolist():
            if out[m] and out[m][-1][1] == begin - 1:
                out[m][-1] = (out[m][-1][0], end - 1)
            else:
                out[m].append((begin, end - 1))
    return out


def _find(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(fp, tid, pos) of all anchors."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [anchors(t.as_py().encode(), length, k) for t in part.column(1)]
                sizes = [len(p) for p, _ in found]
                tids = np.repeat(part.column(0).to_numpy(), sizes)
                yield pa.record_batch([pa.array(np.concatenate([h for _, h in found]).view("i8")), pa.array(tids), pa.array(np.concatenate([p for p, _ in found]))], names=["fp", "tid", "pos"])

    return docs.where(F.octet_length("__text") >= length).select("tid", "__text").mapInArrow(rows, "fp bigint, tid bigint, pos bigint")


def _shared(found: DataFrame, crowds: int = CROWDS) -> DataFrame:
    """(fp, tid, pos, n): anchors whose fingerprint occurs at another place, each place once, and how often it was met.

    Of fingerprints met more often than a `crowds`-th of all anchors there are fewer than `crowds`; these go to every task. So the others'
    exchange has no hot key."""
    place = F.xxhash64("tid", "pos")
    counts = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fp", "n")
    counts = staged(counts, "anchor-counts")
    many = max(LIMIT, found.count() // crowds)
    hot = F.broadcast(counts.where(F.col("n") > many))
    rest = found.join(hot, "fp", "left_anti").join(counts.where(F.col("n") <= many).hint("merge"), "fp")
    return found.join(hot, "fp").unionByName(rest).distinct()


def _joined(docs: DataFrame, table: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """docs and a table by tid; the table goes to every task while it is made of few rows, else both are sorted and merged."""
    return docs.join(F.broadcast(table) if rows <= BROADCAST_ROWS else table.hint("merge"), "tid", how)


CONTEXTS = "fp bigint, tid bigint, left int, context binary, places array<bigint>"


def _contexts(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(fp, tid, left, context, places): each distinct context of an anchor in a text once, with all its places there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["fp", "tid", "left", "context", "places"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for tid, text, places, fps in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = text.as_py().encode()
                own: dict[tuple, list[int]] = {}
                for pos, fp in zip(places, fps, strict=True):
                    begin = max(0, pos - length + k)
                    own.setdefault((fp, tid, pos - begin, data[begin : pos + length]), []).append(pos)
                for key, where in own.items():
                    out.append((*key, where))
                    size += len(key[3]) + 8 * len(where)
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return docs.select("tid", "__text", "places", "fps").mapInArrow(rows, CONTEXTS)


def _grouped(rows: DataFrame, keys: list[str], columns: list[str], of, schema: str) -> DataFrame:
    """What `of` gives for each group's rows of `columns`, as rows of `schema`. Groups are small; a partition streams through."""
    names, types = [f.split()[0] for f in schema.split(", ")], [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def block() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[: len(keys)] != now:
                    out += of(held)
                    now, held = row[: len(keys)], []
                    if len(out) > 10_000:
                        yield block()
                held.append(row[len(keys) :])
        out += of(held)
        if out:
            yield block()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, *columns).repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _covered(contexts: DataFrame, length: int, k: int) -> DataFrame:
    """(tid, begin, end): what groups of contexts cover."""

    def group(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        by_anchor: dict[bytes, dict[tuple, dict[int, list[int]]]] = {}
        for tid, left, context, places in rows:  # a text read twice gives equal rows
            by_anchor.setdefault(context[left : left + k], {}).setdefault((left, context), {})[tid] = places
        for members in by_anchor.values():
            listed = list(members.items())
            if len(listed) == 1 and sum(map(len, listed[0][1].values())) == 1:
                continue
            found = repeated_offsets([(c[:left][::-1], c[left:], sum(map(len, texts.values()))) for (left, c), texts in listed], length, k)
            for ranges, (_, texts) in zip(found, listed, strict=True):
                for tid, places in texts.items() if ranges else ():
                    spans = merged(np.array([(p - b, p - a + length) for p in places for a, b in ranges]))
                    for begin, end in spans.tolist():
                        yield tid, begin, end

    return _grouped(contexts, ["fp"], ["tid", "left", "context", "places"], group, "tid bigint, begin bigint, end bigint")


def _spread(rows: DataFrame, key: str, salt: str, *sums: Column) -> DataFrame:
    """(key, salt, and the sums over all of a key), once for each salt of a key, so that a join by both has no hot key."""
    names = [f"s{i}" for i in range(len(sums))]
    salted = rows.groupBy(key, salt).agg(*(F.sum(c).alias(n) for c, n in zip(sums, names, strict=True)))
    return salted.select(key, salt).join(salted.groupBy(key).agg(*(F.sum(n).alias(n) for n in names)).hint("merge"), key)


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _classes(members: DataFrame, width: int, length: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(part, ext, lo, hi, first, last, owner, salt, n) of members (owner, left, context, n, lo, hi, low, high): the offsets from lo to hi,
    `width` at a time, as far as some lie from low to high. Windows at a part's offsets share a core, whose hash is `part`; `ext` is all
    that the member's see, from first to last. Only `wanted` parts, if these are given (in order)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["part", "ext", "lo", "hi", "first", "last", "owner", "n"], [pa.int64(), pa.binary(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for owner, left, context, n, lo, hi, low, high in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    right = len(context) - left
                    for begin in range(lo + (low - lo) // width * width, high + 1, width):
                        end = min(begin + width - 1, hi)
                        first, last = max(begin, length - right), min(end, left)
                        if first <= last:
                            core = b"%d %d " % (begin, end) + context[left - begin : left + length - end]
                            part = xxhash.xxh3_64_intdigest(core) - 2**63
                            if wanted is not None and ((k := np.searchsorted(wanted, part)) == len(wanted) or wanted[k] != part):
                                continue
                            seen = b"%d %d " % (first, last) + core + b" " + context[left - last : left + length - first]
                            out.append((part, xxhash.xxh3_128_digest(seen), begin, end, first, last, owner, n))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    source = members.select("owner", "left", "context", "n", "lo", "hi", "low", "high")
    return source.mapInArrow(rows, "part bigint, ext binary, lo int, hi int, first int, last int, owner bigint, n bigint").withColumn("salt", _salt("owner"))


SIDES = "owner bigint, part bigint, back binary, right binary, n bigint, lo int, hi int"
NEIGHBOURS = f"{SIDES}, best int, ranges array<struct<first int, last int>>"


def _neighbours(members: DataFrame, by: str, length: int) -> DataFrame:
    """NEIGHBOURS of SIDES, in order of part, `by` and the other side: the longest common prefix of `by` that the member has with another
    of its part, and offsets from lo to hi at which a window occurs in a neighbour, too. The first and the last row of a partition do
    not meet all neighbours, so these meet each other once more; members come in one row or two, and sides are null where not needed."""
    other, fields = {"back": "right", "right": "back"}[by], [f.split()[0] for f in SIDES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), *[pa.int32()] * 3, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[tuple[tuple, list]] = deque()  # rows that still meet others, and [best, ranges, whether the first or last]
        out: list[tuple] = []

        def leave(row: tuple, found: list) -> None:
            best, ranges, edge = found
            sides = row[2:4] if edge else (None, None)
            out.append((*row[:2], *sides, *row[4:], best, [{"first": a, "last": b} for a, b in ranges]))

        def block() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*fields, "best", "ranges"])
            out.clear()
            return made

        begun = False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, part, back, right, n, lo, hi = row
                while held and (held[0][0][1] != part or len(held) > NEAR):
                    leave(*held.popleft())
                mine = [0, [(max(lo, length - len(right)), min(hi, len(back)))] if n > 1 else [], not begun]
                begun = True
                for one, found in held:
                    l, r = common_prefix(back, one[2]), common_prefix(right, one[3])
                    first, last = max(lo, length - r), min(hi, l)
                    for side in (mine, found):
                        side[0] = max(side[0], l if by == "back" else r)
                        if first <= last and not any(a <= first and last <= b for a, b in side[1]):
                            side[1].append((first, last))
                held.append((row, mine))
                if len(out) > 2000:
                    yield block()
        if held:
            held[-1][1][2] = True
        for one in held:
            leave(*one)
        if out:
            yield block()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["part", by, other]
    inner = staged(members.select(*fields).repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(run, NEIGHBOURS), "crowd-neighbours")
    edges = inner.where("back is not null").select(*fields).coalesce(1).sortWithinPartitions(*keys).mapInArrow(run, NEIGHBOURS)  # two rows of each partition
    return inner.unionByName(edges)


def _settled(members: DataFrame, length: int) -> DataFrame:
    """(owner, ranges, low, high, begin, end) of members (part, owner, left, context, n, lo, hi): offsets at which a member's windows are known
    to occur in another place; between which they can; and between which that is open, null if nowhere. Members that can't are left out."""

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [(c[:at][::-1], c[at:]) for at, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            both = [pa.array([c[i] for c in cuts], pa.binary()) for i in (0, 1)]
            yield pa.record_batch([*batch.columns[:2], *both, *batch.columns[4:]], names=[f.split()[0] for f in SIDES.split(", ")])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), *[pa.int32()] * 4]
        for batch in batches:
            out = []
            for owner, lo, hi, l, r, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = max(lo, length - r), min(hi, l)
                known = merged(np.array([(x["first"], x["last"] + 1) for some in lists for x in some], "i8").reshape(-1, 2)).tolist()
                if known:  # of equal contexts, what they have in common is all that they have
                    low, high = min(low, known[0][0]), max(high, known[-1][1] - 1)
                if low > high:
                    continue
                ends = [low, *(x for run in known for x in run), high + 1]
                open_ = [(a, b - 1) for a, b in zip(ends[::2], ends[1::2], strict=True) if a < b]
                begin, end = (open_[0][0], open_[-1][1]) if open_ else (None, None)
                out.append((owner, [{"first": a, "last": b - 1} for a, b in known], low, high, begin, end))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["owner", "ranges", "low", "high", "begin", "end"])

    halves = members.select("owner", "part", "left", "context", "n", "lo", "hi").mapInArrow(sides, SIDES)
    best = lambda by: _neighbours(halves, by, length).select("owner", "lo", "hi", *(F.col("best").alias(s) if s == by else F.lit(0).alias(s) for s in ("back", "right")), "ranges")
    both = best("back").unionByName(best("right")).groupBy("owner").agg(*(F.max(c).alias(c) for c in ("lo", "hi", "back", "right")), F.collect_list("ranges").alias("lists"))  # four rows at most
    return both.mapInArrow(settle, "owner bigint, ranges array<struct<first int, last int>>, low int, high int, begin int, end int")


def _asked(members: DataFrame, width: int, length: int) -> np.ndarray | None:
    """Cores of members at offsets that are open, in order; None if there are too many to go to every task."""
    cores = staged(_classes(members, width, length).select("part").distinct(), "crowd-asked")
    return np.sort(cores.toPandas()["part"].to_numpy("i8")) if cores.count() <= ASKED else None


def _parted(members: DataFrame, widths: list[int], length: int, k: int, limit: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(owner, ranges): ranges of offsets (first, last) at which members' windows occur in another place, in one row or several.

    Members alike in all that a range of offsets sees are one class. The classes of a part go to one task if there are at most `limit`,
    else neighbours in order settle what they can, and for what is open they are parted again, by fewer offsets. With one offset a part is
    one class, and a repeat if two places have it.
    """
    seen = staged(_classes(members, widths[0], length, wanted), "crowd-classes")
    classes = seen.groupBy("part", "ext").agg(F.sum("n").alias("n"), F.min("owner").alias("rep"), *(F.min(c).alias(c) for c in ("lo", "hi", "first", "last"))).withColumn("salt", _salt("ext"))
    classes = staged(classes, "crowd-parts")
    parts = _spread(classes, "part", "salt", F.lit(1), F.col("n")).where("s1 > 1").select("part", "salt", F.col("s0").alias("size"))
    classes = staged(classes.join(parts.hint("merge"), ["part", "salt"]), "crowd-repeats")
    found = classes.where("n > 1").select("ext", "first", "last")
    if len(widths) > 1:
        # what a class sees, of the member that stands for it
        texts = members.select(F.col("owner").alias("rep"), F.col("left").alias("all"), "context")
        left = F.expr(f"substring(context, all - last + 1, last + {length} - first)")
        several = classes.where("size > 1").join(texts.hint("merge"), "rep").select("part", "ext", "n", "size", "lo", "hi", F.col("last").alias("left"), left.alias("context"))

        def group(held: list[tuple]) -> Iterator[tuple[bytes, int, int]]:
            by_anchor: dict[bytes, list[tuple]] = {}
            for row in held:
                by_anchor.setdefault(row[2][row[1] : row[1] + k], []).append(row)
            for listed in by_anchor.values():
                ranges = repeated_offsets([(c[:at][::-1], c[at:], n) for _, at, c, n in listed], length, k)
                yield from ((row[0], first, last) for some, row in zip(ranges, listed, strict=True) for first, last in some)

        small = _grouped(several.where(F.col("size") <= limit), ["part"], ["ext", "left", "context", "n"], group, "ext binary, first int, last int")
        deeper = several.where(F.col("size") > limit).select(F.xxhash64("ext").alias("owner"), "part", "left", "context", "n", "lo", "hi")
        deeper = staged(deeper, "crowd-members")
        found = found.unionByName(small)
        if not deeper.isEmpty():
            settled = staged(_settled(deeper, length), "crowd-settled")
            again = settled.where(F.size("ranges") > 0).select("owner", "ranges")
            unsettled = settled.where("begin is not null").select("owner", F.col("begin").alias("low"), F.col("end").alias("high"))
            if not unsettled.isEmpty():
                asked = _asked(deeper.join(unsettled.hint("merge"), "owner"), widths[1], length)
                partners = staged(deeper.join(settled.select("owner", "low", "high").hint("merge"), "owner"), "crowd-partners")
                again = again.unionByName(_parted(partners, widths[1:], length, k, limit, asked))
            known = again.join(classes.select(F.xxhash64("ext").alias("owner"), "ext").hint("merge"), "owner")
            found = found.unionByName(known.select("ext", F.inline("ranges")))
    found = staged(found.groupBy("ext").agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "crowd-offsets")  # one row each, of a few hundred ranges at most
    spread = seen.select("ext", "salt").distinct().join(found.hint("merge"), "ext")
    return seen.select("ext", "salt", "owner").join(spread.hint("merge"), ["ext", "salt"]).select("owner", "ranges")


def _crowded(contexts: DataFrame, length: int, k: int, limit: int, steps: tuple[int, ...]) -> DataFrame:
    """As _covered, for contexts of anchors that are met often."""
    rows = contexts.dropDuplicates(["fp", "tid", "left", "context"]).withColumn("owner", F.xxhash64("tid", "left", "context")).withColumn("n", F.size("places").cast("bigint"))
    rows = staged(rows.select("owner", "tid", "places", "left", "context", "n", *(F.lit(v).alias(c) for c, v in (("lo", 0), ("hi", length - k), ("low", 0), ("high", length - k)))), "crowds")
    offsets = _parted(rows, [length - k + 1, *steps, 1], length, k, min(limit, PART))
    lists = offsets.groupBy("owner").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))  # a few hundred at most

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                tids, out = [], [np.zeros((0, 2), "i8")]
                for tid, places, ranges in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    out.append(merged(np.array([(p - r["last"], p - r["first"] + length) for p in places for r in ranges], "i8")))
                    tids += [tid] * len(out[-1])
                both = np.concatenate(out)
                yield pa.record_batch([pa.array(tids, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["tid", "begin", "end"])

    return rows.select("owner", "tid", "places").join(lists.hint("merge"), "owner").select("tid", "places", "ranges").mapInArrow(spans, "tid bigint, begin bigint, end bigint")


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, k: int = K, limit: int = LIMIT, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row; kept: the bytes that remain."""
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("__text"), F.xxhash64(body, F.octet_length(body)).alias("tid"))
    texts = staged(docs.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("first")), "texts")
    found = staged(_find(docs, length, k), "anchors")
    shared = staged(_shared(found), "shared-anchors")
    discard(found)
    n_shared = shared.count()
    once = texts.where("copies > 1").select("tid", "first")

    def with_places(anchors_: DataFrame) -> DataFrame:
        lists = anchors_.groupBy("tid").agg(F.collect_list(F.struct("pos", "fp")).alias("l")).select("tid", F.col("l.pos").alias("places"), F.col("l.fp").alias("fps"))
        lists = staged(lists.join(once.hint("merge"), "tid", "left"), "anchor-lists")
        found = _joined(docs, lists, n_shared)  # of equal texts the first row's; rows that repeat id and text come twice and are told apart later
        return found.where(F.col("first").isNull() | F.struct(F.col("doc_id").isNull(), "doc_id").eqNullSafe(F.col("first")))

    spans = _covered(_contexts(with_places(shared.where(F.col("n") <= limit)), length, k), length, k)
    crowd = shared.where(F.col("n") > limit)
    if not crowd.isEmpty():
        spans = spans.union(_crowded(_contexts(with_places(crowd), length, k), length, k, limit, steps))
    spans = staged(spans, "spans")
    n_spans = spans.count()
    cuts = spans.groupBy("tid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    copied = texts.where("copies > 1").select("tid", F.lit(True).alias("copied"))
    known = staged(cuts.join(copied.hint("merge"), "tid", "full"), "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = []
                for t, spans_, whole in zip(part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    data = t.as_py().encode()
                    if whole and len(data) >= length:
                        runs = np.array([[0, len(data)]])
                    else:
                        runs = merged(np.array([(s["begin"], s["end"]) for s in spans_ or ()], "i8").reshape(-1, 2))
                    edges = [0, *runs.ravel().tolist(), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((len(data), len(data) - len(kept), len(runs), kept))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.binary()], strict=True)] if out else [pa.array([], t) for t in [pa.int64()] * 3 + [pa.binary()]]
                yield pa.record_batch([part.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    final = _joined(docs, known, n_spans + known.count(), "left").select("doc_id", "__text", "spans", "copied")
    return final.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def suffix_digests(docs: DataFrame, **options) -> DataFrame:
    """As suffix_dedup, with the SHA-256 of what remains in its place."""
    return suffix_dedup(docs, **options).withColumn("kept", F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")
