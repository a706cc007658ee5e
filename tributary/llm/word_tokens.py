"""Ids of texts under a tokenizers file, by parts that no piece crosses, so that a part is encoded once in a while.

Texts are cut at spaces and line feeds. The tokenizer must drop white space and work within such parts: its normalizers,
patterns and special strings are those of `word_bpe_49k.json`, which `load` checks. A part of plain characters is split into words by
a pattern and each word goes to the BPE model alone; any other part goes through the whole library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from tributary.llm.cache import Memo, alone

#: Fixed values of the tokenizer file: its split pattern, normalizers and byte alphabet rule.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]

#: ASCII without controls, and the Latin letters whose lower case is one letter and that NFC leaves alone.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
#: The split pattern for plain characters after lower-casing.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_alphabet() -> dict[int, str]:
    """Bytes as the visible characters that byte-level vocabularies use: printable Latin-1 stays, the rest counts up from 256."""
    stays = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    moved = (b for b in range(256) if b not in stays)
    return {b: chr(b) for b in stays} | {b: chr(256 + i) for i, b in enumerate(moved)}


class WordTokens:
    """One tokenizer in one process, and what it gave for the parts seen of late."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]["pretokenizers"]
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != NORMALIZERS or [p["type"] for p in pre] != ["Split", "ByteLevel"] or pre[0]["pattern"] != {"Regex": SPLIT} or pre[1]["add_prefix_space"] or any(re.search(r"\s", t["content"]) or t["content"].isalpha() for t in spec["added_tokens"]):
            raise ValueError("this tokenizer is not known to work within parts between spaces")
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.model = self.whole.model
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.marks = {t["content"][0] for t in spec["added_tokens"]}  # special strings are found before case is folded
        self.table = byte_alphabet()
        self.size = self.whole.get_vocab_size()
        self.packed = [i.to_bytes(4, "little") for i in range(self.size)]
        self.words = Memo(self._word, 300_000)
        self.parts = Memo(self._part, 650_000)

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.table)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(spelled)])

    def _plain(self, part: str) -> bool:
        plain = part.isprintable() if part.isascii() else PLAIN.fullmatch(part) is not None
        return plain and (part.isalpha() or not self.special.search(part))

    def pre_tokens(self, part: str) -> list[str]:
        """The words of a plain part; any other part as it is."""
        return WORDS.findall(part.lower()) if self._plain(part) else [part]

    def _part(self, part: str) -> bytes:
        if self._plain(part):
            if part.isalpha():
                return self.words[part.lower()]
            return b"".join(map(self.words.__getitem__, WORDS.findall(part.lower())))
        return np.array(self.whole.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if text.isascii() and not any(c in text for c in self.marks):
            text = text.lower()  # as the library does, only before the look-up
        return b"".join(map(self.parts.__getitem__, parts(text)))

    def count(self, pre_token: str) -> int:
        """Number of ids of one of `pre_tokens`, not remembered."""
        return len(self._word(pre_token) if self._plain(pre_token) else self._part(pre_token)) // 4


def parts(text: str) -> list[str]:
    """A text cut at spaces and line feeds; some parts may be empty."""
    return text.replace("\n", " ").split(" ")


def word_tokens(path: str) -> WordTokens:
    """One for each worker process."""
    return alone(("words", path), lambda: WordTokens(path))
