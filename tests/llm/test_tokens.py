import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from edge import docs

from tributary.llm import token_counts as C
from tributary.llm import token_store as T
from tributary.llm.sentencepiece_codec import Codec, decode_documents, encode_digests, encode_documents
from tributary.llm.word_tokens import WordTokens
from tributary.sources.staging import fresh_path

WORD, PIECE = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def word():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def piece():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def odd_texts(rng, n):
    pools = ["ab th▁  \n\té中\U0001f600e\x00<0x41>s1½ﬁ", "".join(map(chr, range(32, 384))), "'sreveADm 12.,!?́ẞİΣ\x1c\x85 <|endoftext|>"]
    for _ in range(n):
        pool = rng.choice(pools)
        yield "".join(rng.choice(pool) for _ in range(rng.randrange(40)))
        yield "".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(10))


def test_pieces_are_the_librarys(piece):
    codec, rng = Codec(PIECE), random.Random(1)
    for text in odd_texts(rng, 1500):
        ids = piece.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == piece.decode(ids)
        assert codec.summary(text) == (len(ids), ",".join(map(str, ids)), piece.decode(ids))
        assert np.frombuffer(codec.packed(text), "<i4").tolist() == ids


def test_any_ids_decode_as_in_the_library(piece):
    codec, rng = Codec(PIECE), random.Random(2)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(259)]) for _ in range(10)]
        assert codec.decode(ids) == piece.decode(ids)


def test_a_long_word_is_covered_in_linear_time(piece):
    text = "ab" * 20_000 + "aaaaaaaaaaaa" * 1000
    assert Codec(PIECE).encode(text) == piece.encode(text)


def test_encoded_documents(odd, odd_rows, piece):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(r[0], piece.encode(r[1] or "")) for r in odd_rows]
    expected = Counter((i, len(x), sha(",".join(map(str, x))), sha(piece.decode(x))) for i, x in ids)
    assert Counter(map(tuple, encode_digests(odd, PIECE).collect())) == expected
    for got in (decode_documents(encode_documents(odd, PIECE), PIECE), encode_documents(odd, PIECE, decoded=True)):
        assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got.collect()) == Counter((i, tuple(x), piece.decode(x)) for i, x in ids)


def test_words_are_the_librarys(word):
    mine, rng = WordTokens(WORD), random.Random(3)
    for text in odd_texts(rng, 1500):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == word.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_plain_character_is_the_librarys(word):
    mine = WordTokens(WORD)
    for point in range(0x20, 0x180):
        for text in (chr(point), f"a{chr(point)}b", f"1{chr(point)}'s", f"{chr(point)}{chr(point)}!"):
            assert np.frombuffer(mine.encode(text), "<u4").tolist() == word.encode(text, add_special_tokens=False).ids, repr(text)


def test_counts(odd, odd_rows, word, monkeypatch, small_batches):
    expected = Counter()
    for i, t, *_ in odd_rows:
        n = len(word.encode(t or "", add_special_tokens=False).ids)
        expected[i, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(map(tuple, C.token_counts(odd, WORD).collect())) == expected
    monkeypatch.setattr(C, "BLOCK_PARTS", 50)
    monkeypatch.setattr(C, "HELD", 40)
    assert Counter(map(tuple, C.token_counts(odd, WORD).collect())) == expected


def test_packing():
    for n in ([], [0], [1, 2**32 - 1, 7]):
        assert C.unpack(C.pack(np.array(n, "u4"))).tolist() == n


def expected_store(rows, word):
    start, out = 0, []
    for i, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*word.encode(t, add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return Counter(out)


def test_round_trip(odd, odd_rows, word, small_batches):
    assert Counter(map(tuple, T.token_round_trip(odd, WORD).collect())) == expected_store(odd_rows, word)


def test_a_single_document_and_a_wrong_dictionary(spark, word):
    from pyarrow import fs

    frame = docs(spark, [(i, f"document number {i} " * 20, None, None, 0) for i in range(200)])
    path = fresh_path(spark, "tokens")
    manifest = T.write_tokens(frame, path, WORD).collect()
    files, root = fs.FileSystem.from_uri(path)
    with files.open_input_stream(f"{root}/{manifest[0].dictionary}.dict") as f:
        dictionary = f.read()
    assert hashlib.sha256(dictionary).hexdigest() == manifest[0].dictionary
    with files.open_input_file(manifest[0].path) as f:
        shard = T.ShardReader(f, dictionary)
        for k in (len(shard.doc_ids) - 1, 0):
            assert shard.ids(k).tolist() == [*word.encode(f"document number {shard.doc_ids[k]} " * 20, add_special_tokens=False).ids, 2]
        with pytest.raises(ValueError, match="another dictionary"):
            T.ShardReader(f, b"other")


def test_empty(none):
    assert encode_digests(none, PIECE).count() == 0
    assert C.token_counts(none, WORD).count() == 0
    assert T.token_round_trip(none, WORD).count() == 0
