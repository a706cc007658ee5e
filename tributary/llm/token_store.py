"""Token ids in binary shards: each document compressed by itself with one zstandard dictionary that all shards share.

Shard format, all numbers little-endian: the magic ``TRIBTOK1``; the SHA-256 of the dictionary (of nothing, if there is
none); one byte, the width of an id (2 or 4); then one zstandard frame for each document; then the index: a byte for each
document that says whether it has an id, and as signed 64-bit arrays the document ids, the frame ends (counted from the
first frame) and the numbers of tokens; last the index's place, the number of documents, and the magic again. A single
document is read with the footer, the index and one frame. The dictionary lies beside the shards under its SHA-256, and a
reader refuses a shard that names another.

Documents are dealt by ranges of doc_id and sorted, so shards in the order of their numbers hold documents in ascending
order. A shard is written under a name of its own attempt and then moved, so lost or repeated tasks leave no broken shard.

Cases: null text counts as empty, and a document without pieces is its end id alone; documents with equal ids are ordered
by their text and each has its own entry; rows without id come first; texts of any length are one frame; an empty table
gives no shard with documents and an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.folds import smallest_hashes
from tributary.llm.word_tokens import word_tokens
from tributary.sources.staging import fresh_path, staged

MAGIC = b"TRIBTOK1"
HEADER = struct.Struct("<8s32sB")
FOOTER = struct.Struct("<QQ8s")
#: Characters of text for each shard, about; documents and bytes that the dictionary is trained on, and its size. They change sizes, never ids.
SHARD_BYTES, TRAIN_DOCS, TRAIN_BYTES, DICTIONARY_BYTES = 64 << 20, 1_000, 16 << 20, 64 << 10


def width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary, or none if the samples are too few for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ShardWriter:
    """Writes one shard to a binary file."""

    def __init__(self, out, dictionary: bytes, id_width: int):
        self.out, self.width = out, id_width
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.compressor = zstandard.ZstdCompressor(level=3, **given)
        self.ids: list[int | None] = []
        self.ends: list[int] = []
        self.counts: list[int] = []
        self.at = 0
        out.write(HEADER.pack(MAGIC, hashlib.sha256(dictionary).digest(), id_width))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.compressor.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(doc_id)
        self.ends.append(self.at)
        self.counts.append(len(ids))

    def close(self) -> None:
        self.out.write(bytes(i is not None for i in self.ids))
        for values in ([i or 0 for i in self.ids], self.ends, self.counts):
            self.out.write(np.array(values, "<i8").tobytes())
        self.out.write(FOOTER.pack(HEADER.size + self.at, len(self.ids), MAGIC))


class ShardReader:
    """Reads a shard from a random-access file, one document at a time."""

    def __init__(self, file, dictionary: bytes):
        self.file = file
        magic, named, self.width = HEADER.unpack(self._read(0, HEADER.size))
        place, n, end = FOOTER.unpack(self._read(file.size() - FOOTER.size, FOOTER.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token shard, or cut off")
        if named != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        index = self._read(place, n * 25)
        has = np.frombuffer(index, "u1", n)
        ids, self.ends, self.counts = np.frombuffer(index, "<i8", 3 * n, n).reshape(3, n)
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has, strict=True)]
        given = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.decompressor = zstandard.ZstdDecompressor(**given)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        begin = int(self.ends[k - 1]) if k else 0
        frame = self._read(HEADER.size + begin, int(self.ends[k]) - begin)
        return np.frombuffer(self.decompressor.decompress(frame), f"<u{self.width}")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, text: str = "text", doc_id: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes documents, appends `end_id` to each and writes shards below `path`, which every machine must reach.
    Returns a row for each shard that has documents: (shard, path, dictionary, n_docs, n_tokens)."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ending = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def encode(t: str) -> np.ndarray:
        return np.frombuffer(word_tokens(tokenizer).encode(t) + ending, "<u4")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, samples, size, mean, n = width(word_tokens(tokenizer).size), [], 0, 0.0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                mean += (len(t) - mean) / n
                if size < TRAIN_BYTES:
                    samples.append(encode(t).astype(f"<u{w}").tobytes())
                    size += len(samples[-1])
        yield pa.record_batch([pa.array([train_dictionary(samples)], pa.binary()), pa.array([mean], pa.float64())], names=["dictionary", "mean"])

    total = docs.count()
    sample = smallest_hashes(source, ["doc_id", "text"], TRAIN_DOCS, total).select("text")
    trained = sample.coalesce(1).mapInArrow(train, "dictionary binary, mean double").first()
    dictionary = bytes(trained.dictionary) if trained else b""
    name = hashlib.sha256(dictionary).hexdigest()
    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/{name}.dict") as f:
        f.write(dictionary)

    shards = max(int(total * (trained.mean if trained else 0) / shard_bytes) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        files, root = fs.FileSystem.from_uri(path)
        final, own = f"{root}/shard-{shard:07d}.tok", f"{root}/.{shard:07d}-{uuid.uuid4().hex}"
        with files.open_output_stream(own) as f:
            writer = ShardWriter(f, dictionary, width(word_tokens(tokenizer).size))
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    writer.add(i, encode(t.as_py()))
            writer.close()
        if not writer.ids:
            files.delete_file(own)
            return
        files.move(own, final)
        values = [[shard], [final], [name], [len(writer.ids)], [sum(writer.counts)]]
        types = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=["shard", "path", "dictionary", "n_docs", "n_tokens"])

    dealt = source.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return staged(dealt.mapInArrow(write, "shard int, path string, dictionary string, n_docs bigint, n_tokens bigint"), "manifest")


def read_tokens(manifest: DataFrame, path: str) -> DataFrame:
    """Every document of the shards: (doc_id, start, n_tokens, ids_crc32); start counts the ids of all documents before."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(f"{root}/{row['dictionary']}.dict") as f:
                    dictionary = f.read()
                with files.open_input_file(row["path"]) as f:
                    shard = ShardReader(f, dictionary)
                    crcs = [zlib.crc32(shard.ids(k).astype("<u4").tobytes()) for k in range(len(shard.doc_ids))]
                    starts = row["start"] + np.concatenate([[0], np.cumsum(shard.counts)[:-1]]).astype("i8")
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(starts), pa.array(shard.counts), pa.array(crcs, pa.int64())]
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("shard", "path", "dictionary", "start").repartition(n, "shard").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents to a folder of its own in the shared folder and reads them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, tokenizer, end_id), path)
