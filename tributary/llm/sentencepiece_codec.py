"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

A sequence of pieces is the BPE encoding of its text exactly if merging each piece's own text gives that piece, and
merging the text of each two neighbours gives those two. So a text is covered from the left with the longest piece that
an Aho-Corasick automaton found at each position, shorter ones next; a neighbour must pass the check by re-merging
(remembered by pair), and positions from which no cover went on are set in a bitfield and not tried again. Each prefix
has one encoding at most, which keeps this linear.

No piece of these vocabularies has a space mark after another character, so texts are cut before each run of space marks
and a word is encoded once in a while, not at each occurrence.

Cases: null text counts as empty and gives no ids; texts of any length are encoded whole; U+2581 in a text is a space
mark, as in the library. Characters outside the vocabulary become byte pieces. The vocabulary must be of the BPE type with
byte pieces, a dummy prefix and no normalization, else loading raises. Rows that repeat are encoded each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.cache import Memo, alone, small_batches

SPACE = "▁"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")


class Codec:
    """The encoder and decoder of one .model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.silent = {i for i in special if model.is_control(i)}
        if len(self.bytes) != 256 or any(SPACE in p[1:] and p.strip(SPACE) for p in self.pieces) or model.encode("  aＡ") != model.encode(f"{SPACE} aＡ") or model.decode(model.encode(" Ａ")) != " Ａ":
            raise ValueError("this vocabulary is not BPE with byte pieces, a dummy prefix and no normalization")
        normal = [i for i in range(n) if i not in special and i not in self.byte_of]
        self.ids = {self.pieces[i]: i for i in normal}
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a character of a piece is not a piece")
        self.rank = {self.pieces[i]: r for r, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i)))}
        self.found = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.found.add_word(piece, (len(piece) - 1, i))
        self.found.make_automaton()
        #: For each piece, the longest other piece that its text begins with, or -1.
        self.shorter = [next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1) if p in self.ids else -1 for p in self.pieces]
        self.fits: dict[tuple[int, int], bool] = {}
        self.lengths = [len(p) for p in self.pieces]
        self.words = Memo(self._word, 300_000)
        self.id_words = Memo(self._packed, 180_000)

    def merge(self, text: str) -> list[str]:
        """The symbols of a short text after all merges, best first, leftmost of equals."""
        symbols, rank, none = list(text), self.rank.get, 1 << 60
        order = [rank(x + y, none) for x, y in zip(symbols, symbols[1:], strict=False)]
        while order and (best := min(order)) != none:
            at = order.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank(symbols[at - 1] + symbols[at], none)
            if at < len(order):
                order[at] = rank(symbols[at] + symbols[at + 1], none)
        return symbols

    def _fit(self, a: int, b: int) -> bool:
        """Whether b can follow a, or come first if a is -1: merging their text anew must give the two again."""
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        pair = [self.pieces[i] for i in (a, b) if i >= 0]
        ok = self.fits[a, b] = self.merge("".join(pair)) == pair and (a < 0 or self._fit(-1, b))
        return ok

    def _word(self, word: str) -> tuple[int, str, str]:
        ids = self.segment(word if word.startswith(SPACE) else SPACE + word)
        return len(ids), ",".join(map(str, ids)), self._plain(ids)

    def segment(self, text: str) -> list[int]:
        """The ids of a text that already has space marks."""
        longest = [-1] * (len(text) + 1)  # the longest match that starts at each character
        for end, (before, i) in self.found.iter(text):
            longest[end - before] = i  # matches come by their ends, so the last one stays
        out: list[int] = []
        at = 0
        while at < len(text):
            if longest[at] < 0:
                out += [self.bytes[b] for b in text[at].encode()]
                at += 1
                continue
            stop = longest.index(-1, at)
            out += self._cover(longest, at, stop)
            at = stop
        return out

    def _cover(self, longest: list[int], begin: int, end: int) -> list[int]:
        """Covers known characters from begin to end: depth first over matches, longest first."""
        failed = bytearray((end - begin) // 8 + 1)
        lengths, fits, shorter = self.lengths, self.fits, self.shorter
        path: list[int] = []
        at, last, i = begin, -1, longest[begin]
        while at < end:
            while i >= 0:
                to = at + lengths[i]
                if not failed[(to - begin) >> 3] >> ((to - begin) & 7) & 1:
                    ok = fits.get((last, i))
                    if self._fit(last, i) if ok is None else ok:
                        break
                i = shorter[i]
            if i >= 0:
                path.append(i)
                at, last, i = to, i, longest[to]
                continue
            if not path:
                raise AssertionError("no cover")
            failed[(at - begin) >> 3] |= 1 << ((at - begin) & 7)
            gone = path.pop()
            at, last, i = at - lengths[gone], path[-1] if path else -1, shorter[gone]
        return path

    def _cut(self, text: str) -> list[str]:
        return WORDS.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for word in self._cut(text) for i in self.segment(word)]

    def _plain(self, ids: list[int]) -> str:
        """Pieces as text, space marks as spaces; runs of byte pieces as UTF-8, each bad byte as U+FFFD."""
        parts: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                parts.append(utf8(bytes(run)))
                run.clear()
            if i >= 0 and i not in self.silent:
                parts.append(" ⁇ " if self.pieces[i] == "<unk>" and i not in self.ids.values() else self.pieces[i].replace(SPACE, " "))
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the dummy prefix."""
        text = self._plain(ids)
        spoken = [i for i in ids if i not in self.silent][:1]
        return text[1:] if spoken and spoken[0] not in self.byte_of and self.pieces[spoken[0]].startswith(SPACE) else text

    def _packed(self, word: str) -> bytes:
        return np.array(self.segment(word if word.startswith(SPACE) else SPACE + word), "<i4").tobytes()

    def packed(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.id_words.__getitem__, self._pieces_of(text))) if text else b""

    def _pieces_of(self, text: str) -> list[str]:
        simple = "  " not in text and text[0] != " " and text[-1] != " " and SPACE not in text
        return text.split(" ") if simple else self._cut(text)

    def summary(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids as decimals joined by commas, the text decoded from them)."""
        if not text:
            return 0, "", ""
        counts, ids, plain = zip(*map(self.words.__getitem__, self._pieces_of(text)), strict=True)
        return sum(counts), ",".join(ids), "".join(plain)[1:]


def utf8(run: bytes) -> str:
    """UTF-8 with each byte that is not part of a character as U+FFFD."""
    out: list[str] = []
    while run:
        try:
            out.append(run.decode())
            break
        except UnicodeDecodeError as bad:
            out.append(run[: bad.start].decode() + "�")
            run = run[bad.start + 1 :]
    return "".join(out)


def codec(path: str) -> Codec:
    """One for each worker process."""
    return alone(("codec", path), lambda: Codec(path))


def encode_documents(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row; with `decoded` also the text decoded from its ids, by the same worker."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                packed = [c.packed(t.as_py() or "") for t in part.column(1)]
                n = np.array([len(p) // 4 for p in packed], "i8")
                ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
                columns = {"doc_id": part.column(0), "n_tokens": pa.array(n), "ids": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), ids)}
                if decoded:
                    columns["decoded"] = pa.array([c.decode(np.frombuffer(p, "<i4").tolist()) for p in packed], pa.string())
                yield pa.record_batch(list(columns.values()), names=list(columns))

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids array<int>"
    return source.mapInArrow(rows, schema + ", decoded string" if decoded else schema)


def decode_documents(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """`encoded` with the text of its ids as `decoded`; null ids count as none."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        c = codec(model)
        return pd.Series([c.decode([] if i is None else np.asarray(i).tolist()) for i in column], dtype=object)

    return encoded.withColumn("decoded", decoded(F.col(f"`{ids}`")))


def encode_digests(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(model), lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            found = [c.summary(t.as_py() or "") for t in batch.column(1)]
            columns = [batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([sha(f[1]) for f in found], pa.string()), pa.array([sha(f[2]) for f in found], pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(rows, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
