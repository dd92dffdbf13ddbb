"""Byte-level BPE: ids against the file's own library, offsets, round trips, split characters, odd rows."""

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe as B

SMALL = "/root/testdata/sf0.001"
TEXTS = ["", " ", "a", "It's we'll  \n\n x", "don't\t\tstop ", "naïve café – 東京都の天気 12345६७८", "👩‍👩‍👧‍👦🏽", "\x00\x1c \x1f.\x1c", "a  b　　c",
         "<|endoftext|>", "x" * 5_000, "word " * 3_000, "  lead and trail  ", "é ‍", "\r\n\r\n a"]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(B.public_path(), "rb"))}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def spec():
    return B.model(B.public_path())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(100, None, None, None), (None, "no id", "x", 1), (3, TEXTS[3], "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_equal_to_the_files_own_library(spark, plain, spec):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = B.query(spark, SMALL).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = plain.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    ids = _codec().encode([text])[0]
    assert ids.tolist() == _plain().encode_ordinary(text)
    assert _codec().decode(ids).decode() == text


def test_cut_anywhere(plain, spec, monkeypatch):
    monkeypatch.setattr(B, "PART_CHARS", 3)
    monkeypatch.setattr(B, "GROUP_CHARS", 10)
    monkeypatch.setattr(B, "MEMORY_CHARS", 50)
    got = B.Codec(spec).encode(TEXTS)
    assert [x.tolist() for x in got] == [plain.encode_ordinary(t) for t in TEXTS]


def test_every_character(plain, spec):
    """The two libraries agree on what a letter, a number and white space is."""
    codec = B.Codec(spec)
    texts = [f"a{chr(c)}b 1{chr(c)}2.{chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    assert all(x.tolist() == y for x, y in zip(codec.encode(texts), plain.encode_ordinary_batch(texts), strict=True))


def test_very_long_texts(spec, plain):
    for text in ("one two, three. " * 1_000_000, "東京都" * 200_000):
        ids = B.codec(spec).encode([text])[0]
        assert B.codec(spec).decode(ids).decode() == text
    assert ids[:1000].tolist() == plain.encode_ordinary("東京都" * 200_000)[:1000]


def test_odd_rows(spark, odd, spec, plain):
    rows = B.encoded(odd, spec).collect()
    assert len(rows) == len(TEXTS) + 3
    by_id = {r.doc_id: r for r in rows}
    assert by_id[100].ids == [] and by_id[None].ids == plain.encode_ordinary("no id")
    for i, text in enumerate(TEXTS):
        r = by_id[i]
        assert r.ids == plain.encode_ordinary(text)
        covered = np.zeros(len(text), dtype=bool)
        for token, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            covered[a:b] = True
            assert plain.decode_single_token_bytes(token) in text[a:b].encode()
        assert covered.all()
    assert B.digests(odd.limit(0), spec).count() == 0 and B.encoded(odd.limit(0), spec).count() == 0
    back = {r.doc_id: r.text for r in B.decoded(B.encoded(odd, spec), spec).collect()}
    assert back == {**dict(enumerate(TEXTS)), 100: "", None: "no id"}


def test_split_characters(spark, spec, plain):
    ids = plain.encode_ordinary("👩‍👩‍👧‍👦 東 ẞ")
    assert len(ids) > 8
    pieces = [(1, i, [x]) for i, x in enumerate(ids)] + [(2, 0, ids[:1]), (3, 0, [10**6]), (4, 0, None), (5, 0, []), (6, 0, [None])]
    df = spark.createDataFrame(pieces, "doc_id long, start int, ids array<int>")
    got = {r.doc_id: r.text for r in B.decoded_pieces(df.repartition(3), spec).collect()}
    assert got[1] == "👩‍👩‍👧‍👦 東 ẞ" and "�" in got[2]
    assert got[3] is None and got[4] is None and got[5] == "" and got[6] is None
    assert {r.text for r in B.decoded(df.where("doc_id in (3, 4, 6)"), spec).collect()} == {None}


def test_a_file_that_is_not_bpe_is_refused(tmp_path):
    file = tmp_path / "ranks"
    tokens = [bytes([b]) for b in range(256)] + [b"abc"]
    file.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    with pytest.raises(ValueError, match="lower rank"):
        B.model(str(file))


_made = {}


def _codec():
    if "codec" not in _made:
        _made["codec"] = B.Codec(B.model(B.public_path()))
    return _made["codec"]


def _plain():
    if "plain" not in _made:
        _made["plain"] = tiktoken.Encoding("p", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(B.public_path()), special_tokens={})
    return _made["plain"]
