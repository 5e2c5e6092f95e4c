import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from wayline.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = byte_bpe.Codec(open(PATH, "rb").read(), P.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_and_round_trip(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "aaaaaaaaaaaaaaa", "abab" * 5000, "é" * 3001, "a\n\n\n b   \t c", "日本語" * 700, "x" * 20000, "-=" * 9000, "<|endoftext|>"])
def test_long_pre_tokens(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_random_letters():
    rng = random.Random(3)
    for n in (50, 500, 20000):
        text = "".join(rng.choice("etaoinshr") for _ in range(n))
        assert ids(text) == REFERENCE.encode_ordinary(text)


def test_texts_over_the_limit(monkeypatch):
    monkeypatch.setattr(byte_bpe, "_AT_ONCE", 10)
    text = "Some words, and 12 numbers \n\n more zqzqxj" * 50
    for codec in (CODEC, byte_bpe.Codec(open(PATH, "rb").read(), P.PATTERN)):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_pre_tokens_of_one_run_stay_apart():
    rng = random.Random(5)
    pieces = ["".join(rng.choice("abetné日\0") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    got = CODEC.merge([p.encode() for p in pieces])
    whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=CODEC.ranks, special_tokens={})
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode_ordinary(p) for p in pieces]


def test_many_texts_at_once():
    texts = ["", None, "hello wonderful", " x" * 30, "zq" * 400, ""]
    assert CODEC.encode_many(texts) == [CODEC.encode(t) for t in texts]


def test_merger_leaves_its_queue_empty():
    merge = CODEC.merge
    merge([b"hello wonderful", b"zzzzqqqzzzz" * 50])
    assert not any(merge.words) and not any(merge.blocks)


def test_ranks_that_go_back():
    # merging "ab" (3) makes "abc" (0 by its bytes), which comes before the "ab" still queued
    ranks = {b"abc": 0, b"abcab": 1, b"cab": 2, b"ab": 3} | {bytes([b]): 10 + b for b in range(256)}
    whole = tiktoken.Encoding("back", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    merge = byte_bpe.Merger(ranks)
    pieces = ["abcabcab", "abab", "cabcabab" * 40, "aabbcc"]
    assert [np.frombuffer(g, "<u4").tolist() for g in merge([p.encode() for p in pieces])] == [whole.encode_ordinary(p) for p in pieces]


def test_memo_turns_over(monkeypatch):
    monkeypatch.setattr(byte_bpe, "_MEMO", 50)
    text = " ".join(f"wörd{k % 300}x" for k in range(2000))
    assert ids(text) == REFERENCE.encode_ordinary(text)


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_AT_ONCE", 64)
    rows = [(1, None, "k"), (2, "", "k"), (3, "hello wörld", "k"), (3, "hello wörld", "k"), (None, "x" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string").repartition(2)
    out = byte_bpe.decode(byte_bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.select("doc_id", "text", "ids", "decoded", byte_bpe.n_tokens().alias("n")).collect()
    assert len(got) == 5
    for r in got:
        want = REFERENCE.encode_ordinary(r.text or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
    both = byte_bpe.round_trip(df, PATH, P.PATTERN)
    assert both.columns == ["doc_id", "decoded", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r.doc_id), bytes(r.ids), r.n_tokens) for r in both.collect()) == sorted((str(r.doc_id), bytes(r.ids), r.n) for r in got)


def test_query(spark, sf_dir):
    from wayline.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op3_byte_bpe"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = REFERENCE.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_rank_file_is_read_whole():
    assert len(CODEC.ranks) == 50256 and base64.b64decode(base64.b64encode(b"a")) in CODEC.ranks
