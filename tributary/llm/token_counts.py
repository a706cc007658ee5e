"""Token counts without token ids: pieces are counted once for each distinct pre-token and multiplied with frequencies.

Documents are taken in blocks of bounded size. A block keeps its distinct parts (between spaces and line feeds, which no
piece crosses), the pre-tokens that each part is made of, and how often each document has each part, all as packed
numbers. Only (pre-token, block) rows are dealt by pre-token and sorted, so each distinct one is counted once, where the
sorted run of it starts; a frequent one has a row for each block and not for each document. The counts go back to their
blocks in packed rows, and frequencies times counts, summed by document, are the result.

Cases: null text counts as empty and has no tokens; texts of any length are counted whole, a very long one as a block of
its own; special strings within a text count as the library takes them by default. Rows that repeat are counted each. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.word_tokens import WordTokens, parts, word_tokens
from tributary.sources.staging import staged

#: A block ends when its texts or its distinct parts pass these; counts go back when a task holds this many.
BLOCK_CHARS, BLOCK_PARTS, HELD = 64 << 20, 700_000, 2_000_000


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed by byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "u1").reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class Block:
    """Documents and how often each has each of the block's pre-tokens."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids: list = []
        self.n_bytes: list[int] = []
        self.lengths: list[int] = []
        self.which: list[np.ndarray] = []
        self.often: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id, text: str) -> None:
        found = Counter(parts(text))
        found.pop("", None)
        numbers = self.numbers
        which = np.fromiter((numbers.setdefault(p, len(numbers)) for p in found), "u4", len(found))
        often = np.fromiter(found.values(), "u4", len(found))
        order = np.argsort(which)
        self.which.append(np.diff(which[order], prepend=np.uint32(0)))
        self.often.append(often[order])
        self.ids.append(doc_id)
        self.n_bytes.append(len(text.encode()))
        self.lengths.append(len(found))
        self.chars += len(text)

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.numbers) >= BLOCK_PARTS

    def row(self, name: int, id_type: pa.DataType, tokens: WordTokens) -> pa.RecordBatch:
        pieces: dict[str, int] = {}
        spelled = [[pieces.setdefault(p, len(pieces)) for p in tokens.pre_tokens(part)] for part in self.numbers]
        join = lambda a: pack(np.concatenate(a) if a else np.zeros(0, "u4"))
        packed = [pack(np.array(self.lengths, "u4")), join(self.which), join(self.often), pack(np.array([len(s) for s in spelled], "u4")), pack(np.array([p for s in spelled for p in s], "u4"))]
        values = [[name], [list(pieces)], [self.ids], [self.n_bytes], *([p] for p in packed)]
        types = [pa.int64(), pa.list_(pa.string()), pa.list_(id_type), pa.list_(pa.int64()), *[pa.binary()] * 5]
        return pa.record_batch([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["block", "pieces", "ids", "n_bytes", "lengths", "which", "often", "spell_lengths", "spelled"])


def blocks(docs: DataFrame, tokenizer: str, text: str, doc_id: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, block, kind, tokens = TaskContext.get().partitionId() << 20, Block(), pa.int64(), word_tokens(tokenizer)
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block.add(i, t.as_py() or "")
                if block.full():
                    yield block.row(name, kind, tokens)
                    name, block = name + 1, Block()
        if block.ids:
            yield block.row(name, kind, tokens)

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(rows, f"block bigint, pieces array<string>, ids array<{kind}>, n_bytes array<bigint>, lengths binary, which binary, often binary, spell_lengths binary, spelled binary")


def sums_by_run(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these lengths."""
    totals = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return totals[ends] - totals[ends - lengths]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; over_limit: more than `limit` tokens."""
    kind = docs.schema[doc_id].dataType.simpleString()
    made = staged(blocks(docs, tokenizer, text, doc_id), "token-blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, last, last_n, held, rows = word_tokens(tokenizer), None, 0, [], 0

        def packed() -> pa.RecordBatch:
            blocks, at, counts = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((at, blocks))
            blocks, at, counts = blocks[order], at[order].astype("u4"), counts[order].astype("u4")
            names, starts = np.unique(blocks, return_index=True)
            places = [pack(np.diff(a, prepend=np.uint32(0))) for a in np.split(at, starts[1:])]
            found = [pack(n) for n in np.split(counts, starts[1:])]
            return pa.record_batch([pa.array(names, pa.int64()), pa.array(places, pa.binary()), pa.array(found, pa.binary())], names=["block", "at", "n"])

        for batch in batches:
            runs = batch.column(0).dictionary_encode()
            values = runs.dictionary.to_pylist()
            counts = np.array([last_n if v == last else tokens.count(v) for v in values], "i8")
            if values:
                last, last_n = values[-1], int(counts[-1])
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), counts[runs.indices.to_numpy()]))
            rows += batch.num_rows
            if rows >= HELD:
                yield packed()
                held, rows = [], 0
        if rows:
            yield packed()

    pieces = made.select("block", F.posexplode("pieces").alias("at", "piece"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = pieces.select("piece", "block", "at").repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(count, "block bigint, at binary, n binary")

    def totals(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0] for c in left.column_names}
        numbers = lambda c: unpack(row[c].as_py()).astype("i8")
        spelled = numbers("spelled")
        counts = np.zeros(int(spelled.max()) + 1 if len(spelled) else 0, "i8")
        for at, found in zip(right.column("at").to_pylist(), right.column("n").to_pylist(), strict=True):
            counts[np.cumsum(unpack(at).astype("i8"))] = unpack(found)
        by_part = sums_by_run(counts[spelled], numbers("spell_lengths"))
        lengths, which = numbers("lengths"), numbers("which")
        # which: differences of ascending part numbers, begun anew with each document
        run = np.concatenate([[0], np.cumsum(which)])
        at = run[1:] - np.repeat(run[np.cumsum(lengths) - lengths], lengths)
        tokens = sums_by_run(by_part[at] * numbers("often"), lengths)
        return pa.table({"doc_id": row["ids"].values, "n_bytes": row["n_bytes"].values, "n_tokens": pa.array(tokens, pa.int64()), "over_limit": pa.array(tokens > limit, pa.bool_())})

    return made.drop("pieces").groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(totals, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
