"""Exact Jaccard join of documents on word shingles, and the components of its links.

1. Each text becomes the set of its shingles' 64-bit hashes. Texts with equal sets are one node from here on.
2. Tiles are made of nodes that have a shingle and a band of sizes in common; sets near a band's upper edge also visit the next. The
   first pass takes a sample of tiles, two shingles of each node. Within a block of a tile, hashed parity bitmaps give by XOR and bit
   counts a lower bound of the difference and so an upper bound of the overlap; each node is checked exactly, on sorted arrays, against
   those that the bound lets pass, nearest first, until it is linked to all of them or to their components: a forest. Where a tile had
   several blocks, one node of each component found so far meets the others' in new blocks, round by round, so links across blocks
   cost no more than those within, and groups of near copies enter the second pass as one component.
3. Any two sets that reach the threshold share a shingle among the rarest quarter of each (prefix filter; any order that is
   the same for all sets is right, and the order is by class of a frequency sketch over all shingles, of fixed size). The
   first one that they share must leave room for the overlap: its place in a set bounds the partner's size (positional
   filter). Rows of prefixes are dealt by shingle and sorted by set size; those without a partner within both bounds, or
   whose shingle is in one component only, fall away in a streaming pass.
4. What is left forms the tiles of the second pass, which is complete: all nodes of different components that share one are compared by
   their bitmaps, folded to one width. Tiles of many rows are cut into blocks, each pair of blocks a tile of its own.
5. Pairs that pass the bound are checked exactly on sorted arrays, dealt by one side and salted by its number of pairs.

No links between different sets of different components are lost. Identity of shingles and sets is by 64-bit hashes.
Cases: null texts and texts without words have no shingles and are their own component; a text with fewer words than a
shingle is one shingle; equal ids with different texts are nodes of their own and share their id; rows without id take part
and carry a null component only if no linked row has an id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.cache import release, small_batches
from tributary.llm.components import components
from tributary.llm.order_minhash import SEEDS, mixed
from tributary.llm.suffix_dedup import Powers
from tributary.llm.token_counts import pack, unpack
from tributary.sources.staging import staged

WORDS, PERCENT = 5, 75
KEYS, SKETCH_BITS, SLICES = 2, 20, 16
#: Rows of ids that may go to every task; rows of a tile compared as one block; pairs of one node checked in one task; hashes
#: and nodes in one block of a sampled tile, and failed checks of a node there; bits of a bitmap for each shingle; steps in a band; rows
#: of one shingle that a task holds to look for partners (more all count as having one).
BROADCAST_ROWS, BLOCK_ROWS, PAIRS = 2_000_000, 8192, 2000
BLOCK_HASHES, BLOCK_NODES, TRIES, BITS, BANDS, HELD = 4 << 20, 512, 8, 2, 4, 1_000_000
_U = np.uint64
#: A random number for each byte, and what each byte counts as: A-Z as a-z, and whether it parts words.
BYTES = np.random.default_rng(1).integers(0, 2**63, 256, dtype="u8") * _U(2) + _U(1)
BYTES[65:91] = BYTES[97:123]
PARTS = np.isin(np.arange(256), [32, *range(9, 14)])


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, in order, from sums of byte numbers times powers."""
    data = np.frombuffer(text.encode(), "u1")
    edges = np.flatnonzero(np.diff(PARTS[data], prepend=True, append=True))
    begins, ends = edges[::2], edges[1::2]
    up, down = Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * down[begins] + (ends - begins).astype("u8"))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    size = min(words, len(h))
    out = np.zeros(len(h) - size + 1, "u8")
    for i in range(size):
        out += h[i : i + len(out)] * SEEDS[100 + i]
    out = np.sort(mixed(out + _U(size)))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def bitmap_size(n: int) -> int:
    """Bits of a set's bitmap: a power of two, some for each shingle."""
    return max(64, BITS << (n - 1).bit_length())


def bitmap(hashes: np.ndarray, bits: int | None = None) -> bytes:
    """Parity bits of a set."""
    bits = bits or bitmap_size(len(hashes))
    ones = np.bincount((hashes & _U(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(ones.astype("u1"), bitorder="little").tobytes()


def folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, wider ones folded by XOR to `size` bytes."""
    out = np.empty((len(maps), size // 8), "u8")
    lengths = np.array([len(m) for m in maps])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        same = np.frombuffer(b"".join([maps[i] for i in at.tolist()]), "u8").reshape(len(at), -1, size // 8)
        out[at] = np.bitwise_xor.reduce(same, axis=1)
    return out


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def band(n: Column, percent: int) -> Column:
    """Bands of sizes, each as wide as `BANDS` steps from a set to the largest that can reach the threshold with it."""
    return F.floor(F.log(n) / (BANDS * float(np.log(100 / percent))) + 1e-9).cast("int")


def _scan(docs: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    """Pass 1. A row for each document (slot -1), and rows with parts of the frequency sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        names = ["slot", "doc_id", "n", "sid", "keys", "bits", "counts"]
        sketch, seen = np.zeros(1 << SKETCH_BITS, "u4"), []
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for batch in batches:
            types[1] = batch.schema.field(0).type
            out: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(t.as_py(), words)
                if not len(s):
                    out.append((-1, i, 0, None, None, None, None))
                    continue
                seen.append(s >> _U(64 - SKETCH_BITS))
                if len(seen) == 500:
                    sketch += np.bincount(np.concatenate(seen).astype("i8"), minlength=len(sketch)).astype("u4")
                    seen.clear()
                keys = [int((s * SEEDS[k]).min().view("i8")) for k in range(KEYS)]
                out.append((-1, i, len(s), set_id(s), keys, bitmap(s), None))
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if seen:
            sketch += np.bincount(np.concatenate(seen).astype("i8"), minlength=len(sketch)).astype("u4")
        if sketch.any():
            parts = sketch.reshape(SLICES, -1)
            task = TaskContext.get().partitionId()
            out = [(k, None, task, None, None, None, pack(p)) for k, p in enumerate(parts)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(rows, f"slot int, doc_id {kind}, n bigint, sid bigint, keys array<bigint>, bits binary, counts binary")


def _classes(scanned: DataFrame) -> np.ndarray:
    """Frequency classes of the sketch's buckets, one byte each: sums of all tasks' counts, in two levels."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SLICES, "u8")
        for packed in table.column("counts").to_pylist():
            total += unpack(packed)
        return pa.table({"slot": table.column("slot")[:1], "counts": pa.array([pack(np.minimum(total, 2**32 - 1))], pa.binary())})

    parts = scanned.where("slot >= 0").select("slot", "counts", (F.col("n") % 32).alias("salt"))
    once = parts.groupBy("slot", "salt").applyInArrow(add, "slot int, counts binary")
    classes = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), "u1")
    for row in once.groupBy("slot").applyInArrow(add, "slot int, counts binary").collect():
        classes[row.slot] = np.log2(unpack(row.counts) + 1.0) * 7
    return classes.ravel()


def _lookup(docs: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """docs joined with a table of ids: sent to every task while it has few rows, else sorted and merged."""
    small = table.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(table) if small else table.hint("merge"), docs["__id"].eqNullSafe(table["__key"]), how)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, hashes) of wanted nodes (sid, __key: an id of theirs)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sids, sets = [], []
                for t, want in zip(batch.column(0).slice(at, 500), batch.column(1).slice(at, 500).to_pylist(), strict=True):
                    s = shingles(t.as_py(), words)
                    if len(s) and (sid := set_id(s)) in want:
                        sids.append(sid)
                        sets.append(s.tobytes())
                yield pa.record_batch([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "hashes"])

    by_id = wanted.groupBy("__key").agg(F.collect_set("sid").alias("want"))
    return _lookup(docs, by_id, "inner").select("__text", "want").mapInArrow(rows, "sid bigint, hashes binary").dropDuplicates(["sid"])


def _reach(n: Column, percent: int) -> Column:
    """The band of the largest set that can reach the threshold with one of n."""
    return F.greatest(band(n, percent), band(n * (100 / percent * (1 + 1e-9)), percent))


def _sampled_tiles(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): links within sampled tiles, block by block, then between the blocks' components."""
    tile = ["k", "key", "band"]
    left = nodes.select("sid", "__key", "n", F.posexplode("keys").alias("k", "key")).withColumn("band", F.explode(F.sequence(band(F.col("n"), percent), _reach(F.col("n"), percent))))
    found, before, turn = None, None, 0
    while True:
        sizes = left.groupBy(*tile).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("hashes")).where("c > 1")
        blocks = F.greatest(F.ceil(F.col("c") / BLOCK_NODES), F.ceil(F.col("hashes") / BLOCK_HASHES)).cast("int")
        members = left.join(sizes.select(*tile, blocks.alias("blocks")).hint("merge"), tile)
        members = staged(members.withColumn("block", F.pmod(F.xxhash64("sid", "k", F.lit(turn)), F.col("blocks")).cast("int")), "tile-members")
        links_ = staged(_block_links(docs, members, words, percent).distinct(), "sample-links")
        found = links_ if found is None else staged(found.union(links_).distinct(), "sample-links")
        cut = members.where("blocks > 1")
        n = cut.count()
        if not n or (before is not None and 2 * n > before):  # what is left is for the second pass
            return found
        grouped = staged(components(found), "sample-components")
        known = cut.join(grouped.hint("merge"), F.col("sid") == F.col("node"), "left").withColumn("c", F.coalesce("component", "sid"))
        one = known.groupBy(*tile, "c").agg(F.min(F.struct("sid", "__key", "n")).alias("one"))
        left, before, turn = staged(one.select(*tile, "one.*"), "tile-members"), n, turn + 1


def _block_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): links within blocks of tiles, as a forest for each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["k", "key", "band", "block", "sid", "hashes"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for t, want in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = shingles(t.as_py(), words)
                if len(s):
                    sid, packed = set_id(s), s.tobytes()
                    out += [(w["k"], w["key"], w["band"], w["block"], sid, packed) for w in want if w["sid"] == sid]
                if len(out) >= 500:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def forest(sids: list[int], found: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        n = np.array([len(s) for s in found])
        bits = min(bitmap_size(int(np.median(n))), 1 << 16)
        maps = np.array([np.frombuffer(bitmap(s, bits), "u8") for s in found])
        root = np.arange(len(sids))
        for i in range(1, len(sids)):
            apart = np.bitwise_count(maps[i] ^ maps[:i]).sum(axis=1, dtype="i8")
            most = (n[i] + n[:i] - apart) // 2
            fits = np.flatnonzero(100 * most >= percent * (n[i] + n[:i] - most))
            fails = 0
            while len(fits) and fails < TRIES:
                j = fits[apart[fits].argmin()]
                both = len(np.intersect1d(found[i], found[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    if sids[i] != sids[j]:
                        yield sids[i], sids[j]
                    old = root[j]
                    root[: i + 1][root[: i + 1] == old] = root[i]
                    fits = fits[root[fits] != root[i]]
                else:
                    fails += 1
                    fits = fits[fits != j]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sids, found = None, [], []

        def done() -> pa.RecordBatch:
            links_ = list(forest(sids, found))
            return pa.record_batch([pa.array([x[k] for x in links_], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for *group, sid, packed in zip(*(batch.column(c).to_pylist() for c in range(5)), batch.column(5), strict=True):
                if group != now:
                    if len(sids) > 1:
                        yield done()
                    now, sids, found = group, [], []
                sids.append(sid)
                found.append(np.frombuffer(packed.as_py(), "u8"))
        if len(sids) > 1:
            yield done()

    place = ["k", "key", "band", "block"]
    wanted = staged(members.groupBy("__key").agg(F.collect_list(F.struct("sid", *place)).alias("want")), "groups")
    dealt = _lookup(docs, wanted, "inner").select("__text", "want").mapInArrow(sets, "k int, key bigint, band int, block int, sid bigint, hashes binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *place).sortWithinPartitions(*place, "sid").mapInArrow(rows, "u bigint, v bigint")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold. Each node's set goes once to each salt of its pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, a_now = None, None
        for batch in batches:
            a_s, b_s = [], []
            for a, b, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                s = np.frombuffer(packed.as_py(), "u8")
                if b is None:
                    a_now, own = a, s
                    continue
                if a != a_now:
                    continue
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(s) - both):
                    a_s.append(a)
                    b_s.append(b)
            yield pa.record_batch([pa.array(a_s, pa.int64()), pa.array(b_s, pa.int64())], names=["u", "v"])

    degree = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("salts"))
    left = degree.join(sets, F.col("a") == F.col("sid")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("bigint").alias("b"), "hashes")
    right = pairs.join(degree, "a").join(sets, F.col("b") == F.col("sid")).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "hashes")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.union(right).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(rows, "u bigint, v bigint")


def _prefixes(docs: DataFrame, nodes: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """(key, sid, comp, n, most): the rarest shingles of each node, read from the row with the node's first id; most: the
    largest partner for which the shingle can be the first shared one."""
    held = docs.sparkSession.sparkContext.broadcast(classes)  # of fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                keys, most, sids, comps, sizes, ns = [], [], [], [], [], []
                for t, known in zip(batch.column(0).slice(at, 200), batch.column(1).slice(at, 200).to_pylist(), strict=True):
                    s = shingles(t.as_py(), words)
                    if not len(s):
                        continue
                    sid = set_id(s)
                    state = next((k for k in known or () if k["sid"] == sid), None)
                    if state and state["skip"]:
                        continue
                    ranked = (order[(s >> _U(64 - SKETCH_BITS)).astype("i4")].astype("u8") << _U(56)) | (s & _U(2**56 - 1))
                    n, p = len(s), prefix_size(len(s), percent)
                    keys.append(np.sort(np.partition(ranked, p - 1)[:p] if p < n else ranked))
                    # at place k the overlap is n - k at most, and must reach percent / (100 + percent) of both sizes
                    most.append(((100 + percent) * (n - np.arange(p)) - percent * n) // percent)
                    sids.append(sid)
                    comps.append(state["comp"] if state else sid)
                    sizes.append(p)
                    ns.append(n)
                each = lambda v, t: np.repeat(np.array(v, t), sizes)
                flat = lambda v, t: np.concatenate(v).astype(t) if v else np.zeros(0, t)
                yield pa.record_batch([pa.array(flat(keys, "u8").view("i8")), pa.array(each(sids, "i8")), pa.array(each(comps, "i8")), pa.array(each(ns, "i4")), pa.array(flat(most, "i4"))], names=["key", "sid", "comp", "n", "most"])

    known = nodes.where("skip or comp <> sid").groupBy("__key").agg(F.collect_list(F.struct("sid", "skip", "comp")).alias("known"))
    return _lookup(docs, known, "left").select("__text", "known").mapInArrow(rows, "key bigint, sid bigint, comp bigint, n int, most int")


def with_partner(key: np.ndarray, comp: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of rows sorted by (key, n), those with another row of their key such that neither is larger than the other's `most`,
    in keys of two components. Rows of one component count as partners, too, so some rows may stay in vain."""
    alive = np.arange(len(key))
    for _ in range(2):
        if not len(alive):
            break
        k, c, size, room = (x[alive] for x in (key, comp, n, most))
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(k))))
        several = (np.minimum.reduceat(c, starts) != np.maximum.reduceat(c, starts))[group]
        base = group.astype("i8") << 32
        value = base | room
        first = np.maximum.accumulate(value)
        newest = np.maximum.accumulate(np.where(np.concatenate([[True], value[1:] > first[:-1]]), np.arange(len(k)), 0))
        second = np.maximum.accumulate(np.concatenate([[-1], np.minimum(value[1:], first[:-1])]))
        upto = np.searchsorted(base | size, base | room, side="right") - 1  # the last row of a fitting size
        best = np.where(newest[upto] == np.arange(len(k)), second[upto], first[upto])
        best[upto < 0] = -1
        alive = alive[several & (best >> 32 == group) & ((best & 0xFFFFFFFF) >= size)]
    return alive


def _with_partner(prefixes: DataFrame) -> DataFrame:
    """Rows that with_partner keeps, key by key."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "sid", "comp", "n", "most"]
        held: list[list[np.ndarray]] = []
        flooded = None  # a key of more rows than are held: all go on

        def out(columns: list[np.ndarray], at) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c[at]) for c in columns], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            last = held[-1][0][-1]
            if held[-1][0][0] == last and sum(len(h[0]) for h in held) < HELD:
                continue
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            open_ = columns[0] == last
            done = [c[~open_] for c in columns]
            rest = [c[open_] for c in columns]
            if flooded is not None:
                ran = done[0] == flooded
                if ran.any():
                    yield out(done, ran)
                    done = [c[~ran] for c in done]
                if last != flooded:
                    flooded = None
            if len(done[0]):
                yield out(done, with_partner(done[0], done[2], done[3], done[4]))
            if last == flooded or len(rest[0]) >= HELD:
                yield out(rest, slice(None))
                flooded, held = last, []
            else:
                held = [rest]
        if held:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            ran = columns[0] == flooded if flooded is not None else np.zeros(len(columns[0]), bool)
            yield out(columns, ran)
            columns = [c[~ran] for c in columns]
            yield out(columns, with_partner(columns[0], columns[2], columns[3], columns[4]))

    n = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prefixes.repartition(n, "key").sortWithinPartitions("key", "n").mapInArrow(rows, "key bigint, sid bigint, comp bigint, n int, most int")


def _tile_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that the bitmaps' bound lets pass, tile by tile."""

    def compare(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        # (home, side, sid, comp, n, most, bits); pairs are home with home or below, and of two blocks one from each
        home = np.array([r[0] for r in rows], bool)
        side = np.array([r[1] for r in rows], "i4")
        sid, comp, n, room = (np.array([r[k] for r in rows], "i8") for k in (2, 3, 4, 5))
        maps = folded([r[6] for r in rows], min(len(r[6]) for r in rows))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        two = bool((side != side[0]).any())
        step = max(1, (8 << 20) // (maps.shape[1] * 8 * len(rows)))
        for at in range(0, len(rows), step):
            i = slice(at, at + step)
            ok = (comp[i, None] != comp[None, :]) & (home[i, None] | home[None, :]) & (np.arange(len(rows))[i, None] < np.arange(len(rows))[None, :])
            ok &= (n[None, :] <= room[i, None]) & (n[i, None] <= room[None, :])
            if two:
                ok &= side[i, None] != side[None, :]
            x, y = ok.nonzero()
            if len(x):
                apart = np.bitwise_count(maps[x + at] ^ maps[y]).sum(axis=1, dtype="i8")
                whole = n[x + at] + n[y]
                # overlap <= (whole - apart) / 2 must be able to reach percent / 100 of the union
                most = (whole - apart) // 2
                good = 100 * most >= percent * (whole - most)
                found.append((x[good] + at, y[good]))
        x, y = (np.concatenate(f) if found else np.zeros(0, "i8") for f in (zip(*found, strict=True) if found else ((), ())))
        return sid[x.astype("i8")], sid[y.astype("i8")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def done() -> pa.RecordBatch:
            a, b = compare(held)
            held.clear()
            return pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != tile:
                    if len(held) > 1:
                        yield done()
                    held.clear()
                    tile = row[:4]
                held.append(row[4:])
        if len(held) > 1:
            yield done()

    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tile = ["key", "band", "x", "y"]
    dealt = tiles.select(*tile, "home", "side", "sid", "comp", "n", "most", "bits").repartition(n, *tile).sortWithinPartitions(*tile)
    return dealt.mapInArrow(rows, "a bigint, b bigint").distinct()


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents with n and sid, components of nodes as (node, component))."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    scanned = staged(_scan(docs, "__text", "__id", words), "shingle-scan")
    rows = scanned.where("slot = -1").select("doc_id", "n", "sid", "keys", "bits")
    nodes = staged(rows.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("__key"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    found = _sampled_tiles(docs, nodes, words, percent)
    grouped = staged(components(found), "group-components")

    known = staged(rows.where("sid is not null").join(nodes.select("sid", "__key").hint("merge"), "sid").join(grouped.hint("merge"), F.col("sid") == F.col("node"), "left")
                   .select(F.col("doc_id").alias("__row"), "sid", (~F.col("doc_id").eqNullSafe(F.col("__key"))).alias("skip"), F.coalesce("component", "sid").alias("comp")).distinct()
                   .withColumnRenamed("__row", "__key"), "known")
    live = staged(_with_partner(_prefixes(docs, known, _classes(scanned), words, percent)), "live")
    sized = live.distinct().withColumn("band", band(F.col("n"), percent)).withColumn("reach", _reach(F.col("n"), percent))
    both = sized.withColumn("own_band", F.col("band")).withColumn("band", F.explode(F.sequence("band", "reach"))).select("key", "band", (F.col("band") == F.col("own_band")).alias("home"), "sid", "comp", "n", "most")
    counts = both.groupBy("key", "band").agg(F.count(F.lit(1)).alias("rows"), F.max("home").alias("any"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("any and c0 <> c1")
    counts = counts.select("key", "band", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks"))
    cut = both.join(counts.hint("merge"), ["key", "band"]).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    tiles = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("key", "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("home"), F.col("own").alias("side"), "sid", "comp", "n", "most")
    tiles = staged(tiles, "tiles")
    bits = rows.select("sid", "bits").join(tiles.select("sid").distinct().hint("merge"), "sid", "left_semi").dropDuplicates(["sid"])
    tiles = tiles.join(bits.hint("merge"), "sid")
    pairs = staged(_tile_pairs(tiles, percent), "tile-pairs")
    more = staged(verify(pairs, staged(_wanted_sets(docs, pairs, nodes, words), "pair-sets"), percent), "tile-links")
    return rows, staged(components(found.union(more)), "components")


def _wanted_sets(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    return _sets(docs, staged(nodes.select("sid", "__key").join(ids.hint("merge"), "sid", "left_semi"), "wanted"), words)


def ngram_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: documents link when 100 * overlap >= percent * union, and a
    component's id is its smallest document id."""
    rows, found = links(docs, text, doc_id, words, percent)
    placed = rows.join(found.hint("merge"), F.col("sid") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "sid").alias("c"))
    placed = staged(placed.withColumn("salt", F.when(F.col("c").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(64)))), "placed")
    # a component may hold a third of all rows: its smallest id goes back by (component, salt)
    salted = placed.where("c is not null").groupBy("c", "salt").agg(F.min("doc_id").alias("least"))
    least = salted.groupBy("c").agg(F.min("least").alias("least"))
    spread = salted.select("c", "salt").join(least.hint("merge"), "c")
    out = placed.join(spread.hint("merge"), ["c", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose id is their component's smallest, with all their columns. An id of several rows goes only if
    none of them is its component's smallest."""
    found = ngram_join(docs, text, doc_id, **options)
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")).where("not stays").select(F.col("doc_id").alias("__gone"))
    gone = staged(gone, "near-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["__gone"]), "left_anti")
