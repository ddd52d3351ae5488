"""Merge replay against the tokenizer library, and exact round trips."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from paragauge.llm import bpe_replay

ODD = [
    None, "", " ", "\n\n  x", "a" * 50, "aaaaaaa bbbbbb  \n\n  x", "日本語テキスト", "the the\tthe'll 123 ###$$$",
    "̀́e" * 30, " " * 40, "z" * 3000, "the the\tthe'll 123 ###$$$",
]


@pytest.fixture(scope="module")
def library():
    ranks = bpe_replay.vocabulary(bpe_replay.RANKS).ranks
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def texts():
    some = random.Random(5)
    letters = "aaabcdeé ñßthing日\n' 1#\U0001f600"
    made = ["".join(some.choice(letters) for _ in range(some.randint(1, 60))) for _ in range(300)]
    long = "".join(some.choice("abcdefghij klmnopqrstuvwxyz") for _ in range(200_000))
    return [*ODD, *made, long]


def test_equals_library_and_round_trip(spark, library):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int"
    )
    got = {r.doc_id: r for r in bpe_replay.encode(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = library.encode_ordinary(text or "")
        assert got[i].ids == ",".join(map(str, want))
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(got[i].ids.encode()).hexdigest()
        assert bytes(got[i].decoded) == (text or "").encode() == bpe_replay.decode(got[i].ids)
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_forgetting_keeps_results(library, monkeypatch):
    monkeypatch.setattr(bpe_replay, "CACHE", 3)
    own = bpe_replay.Encoder(bpe_replay.RANKS)
    for text in texts()[2:200]:
        pieces = own.pattern.findall(text)
        own.learn(set(pieces))
        assert ",".join(own.known[p][1] for p in pieces) == ",".join(
            map(str, library.encode_ordinary(text))
        )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_replay.encode(docs).collect() == []
