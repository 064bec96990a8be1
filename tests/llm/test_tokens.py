import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwick.llm import bpe, token_store
from tarnwick.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def library_ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_codec_against_the_library(library):
    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABC0123 '’.,!<|>\t\n\u200béßΣİςµ中文🙂日\x00\x85\u00a0ﬁ½e\u0301"
    texts = ["", "   ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "'SUPPER don't \"'s", "x" * 3000, "é" * 900, "the" * 2000, "----...!!!" * 90]
    texts += ["".join(r.choice(part) for _ in range(n)) for part in ("the", "ab", "éa", "中文", "thingsé!-", "ø þß") for n in (499, 501, 700, 4000)] + ["b" * 200_000 + " x"]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(r.choice(["th", "er", "ing", "tion", "é", "an"]) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    codec = bpe.Codec(tokenizer_path())
    for text, ids in zip(texts, codec.encode_all(texts)):
        wanted = library_ids(library, text)
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text
        assert codec.decode(ids) == library.decode(wanted, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_codec_property(text):
    from tokenizers import Tokenizer

    lib = test_codec_property.__dict__.setdefault("lib", Tokenizer.from_file(tokenizer_path()))
    assert np.frombuffer(bpe.codec(tokenizer_path()).encode(text), "<u4").tolist() == library_ids(lib, text)


def test_merge_equals_the_engine(library):
    """On parts that both can take."""
    codec, r = bpe.codec(tokenizer_path()), random.Random(4)
    for _ in range(500):
        part = "".join(r.choice("theingaotisr") for _ in range(r.randint(1, 60))).encode() + r.choice([b"", b"\n"])
        assert bpe.merge(part, codec.ranks) == codec.engine.encode_ordinary(part.decode())


def test_forced_cuts_are_certain(library):
    """No token holds a space, and at a pair that no token holds the library's tokens end, too."""
    codec = bpe.Codec(tokenizer_path())
    assert not codec.joined[0x21:, 0x20].any() and not codec.joined[0x20, 0x21:].any()
    letters = "abcdefghijklmnopqrstuvwxyzßéñøæþđ"
    forced = [(a, b) for a in letters for b in letters if not codec.joined[a.encode()[-1], b.encode()[0]]]
    assert forced
    for a, b in forced:
        first = library.encode(f"the{a}{b}the", add_special_tokens=False)
        assert any(end == 3 + len(a) for _, end in first.offsets)


def test_bpe_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op7_bpe"](spark, sf_dir).collect():
        ids = library_ids(library, texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_store_query(spark, sf_dir, library):
    texts = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    at, wanted = 0, {}
    for doc_id, text in texts:
        ids = [*library_ids(library, text), 1]
        wanted[doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op2_token_binary"](spark, sf_dir).collect()} == wanted


def test_encode_decode_frames(spark, odd, empty):
    rows = bpe.decode(bpe.encode(odd, tokenizer_path()), tokenizer_path()).collect()
    assert len(rows) == odd.count() and sum(r.text == "" for r in rows) == 4
    assert bpe.round_trip(odd, tokenizer_path()).count() == odd.count()
    assert bpe.round_trip(empty, tokenizer_path()).count() == 0


def test_store_odd_rows(spark, odd, empty, tmp_path):
    token_store.write(odd, f"file://{tmp_path}/a", tokenizer_path(), 1)
    rows = token_store.digests(spark, f"file://{tmp_path}/a").orderBy("start").collect()
    assert len(rows) == odd.count()
    ids = [r.doc_id for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    whole = {(r.doc_id, zlib.crc32(bytes(r.ids))) for r in token_store.read(spark, f"file://{tmp_path}/a").collect()}
    assert whole == {(r.doc_id, r.ids_crc32) for r in rows}
    token_store.write(empty, f"file://{tmp_path}/b", tokenizer_path(), 1)
    assert token_store.digests(spark, f"file://{tmp_path}/b").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_pack_round_trip(values):
    ids = np.array(values, np.uint64)
    words, at, escapes = token_store.pack(ids)
    assert token_store.unpack(words, len(ids), at, escapes).tolist() == values
    assert len(at) == sum(v >= 1 << 60 for v in values)


def test_pack_is_dense():
    words, _, _ = token_store.pack(np.zeros(6000, np.uint64))
    assert len(words) == 800
    words, _, _ = token_store.pack(np.full(6000, 30_000, np.uint64))
    assert len(words) == 1500 * 8


def test_full_cache_keeps_what_was_met_first_and_finds_each_fragment_once(monkeypatch):
    codec = bpe.Codec(tokenizer_path())
    texts = ["common"] + [f"common Words here {i} x{i}y Zé{i}! <|endoftext|> {'' if i % 3 else None}" for i in range(40)] + [None, "", " \n"]
    plain = codec.encode_all(texts)
    small = bpe.Codec(tokenizer_path())
    monkeypatch.setattr(bpe, "CACHE", 12)
    learnt, learn = [], small.learn
    monkeypatch.setattr(small, "learn", lambda fragments: (learnt.extend(fragments), learn(fragments)))
    assert [small.encode_all([t])[0] for t in texts] == plain
    assert len(small.known) < 30 and learnt.count(b"common") == 1 < learnt.count(b"here")  # the first quarter stays
