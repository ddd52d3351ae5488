"""Removal of repeated byte strings against a plain search over all starts."""

import hashlib
import random

import numpy as np
import pytest

from paragauge.llm import prefix_doubling as P


def brute(texts, length):
    places = {}
    for d, text in enumerate(texts):
        for i in range(len(text) - length + 1):
            places.setdefault(text[i : i + length], []).append((d, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                gone[d][i : i + length] = True
    out = []
    for text, g in zip(texts, gone):
        kept = np.frombuffer(text, np.uint8)[~g].tobytes()
        spans = int((np.diff(g.astype(np.int8), prepend=0) == 1).sum())
        out.append((len(text), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(30), prose(120)
    texts = [prose(rng.randint(0, 150)) for _ in range(12)]
    texts += [prose(9) + passage + prose(9) for _ in range(5)]  # a passage in many texts
    for _ in range(12):  # near copies
        words = base.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [base, base, "", None, "x", "a" * 300, "ab" * 200 + "c", passage * 3]
    long = prose(900)
    texts += [long, long[333:2222], long[:2000] + "!" + long[2000:]]
    rng.shuffle(texts)
    return texts


def run(spark, texts, length, partitions):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(partitions)
    got = P.remove_repeats(docs, length=length).collect()
    assert len(got) == len(texts)
    return [tuple(r)[1:] for r in sorted(got, key=lambda r: r[0])]


@pytest.mark.parametrize("seed,length,heavy", [(1, 40, 20_000), (2, 200, 3), (3, 17, 8)])
def test_equals_brute_force(spark, monkeypatch, seed, length, heavy):
    """Also with frequent phrases, whose strings are asked for one by one."""
    monkeypatch.setattr(P, "HEAVY", heavy)
    texts = corpus(seed)
    want = brute([(t or "").encode() for t in texts], length)
    assert run(spark, texts, length, 3) == want


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 103, 5000).astype(np.uint8)
    off = np.array([0, 0, 700, 700, 703, 4000, 5000])
    want = P.anchors(data, off, 20)
    monkeypatch.setattr(P, "CHUNK", 300)
    got = P.anchors(data, off, 20)
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
    # Every window of 20 positions inside a text has its anchor, and equal windows the same one.
    for i in range(703, 4000 - 26):
        own = np.searchsorted(want[1], i, "right") - 1
        assert i <= want[0][own] < i + 20
    start = np.array([0, 5, 290, 2000])
    whole = P.names(data, start, start + 400)
    monkeypatch.setattr(P, "CHUNK", 1 << 20)
    assert np.array_equal(whole, P.names(data, start, start + 400))


def test_rank_names_what_is_repeated():
    ranks, counts = P.rank(np.array([7, 3, 7, 9, 3, 5], np.uint64), 0)
    assert ranks.tolist() == [3, 1, 3, 0, 1, 0] and counts.tolist() == [2, 2, 2, 1, 2, 1]


def test_shifts_find_strings_on_both_sides():
    """Two anchors share three bytes before and four behind: shifts that fit both sides are hits."""
    window, texts = 6, [b"xbcdKEFGHyz", b"qbcdKEFGHww"]  # K stands for the shared bytes
    sides = b"".join(t[:4] + t[5:11] for t in texts)
    ones = np.ones(2, np.uint64)
    hit = P.shifted(
        ones, ones.astype(np.uint32), np.array([0, 0]), np.array([4, 4]), np.frombuffer(sides, np.uint8), window
    )
    assert hit.tolist() == [[False, False, True, True, False, False]] * 2


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.remove_repeats(empty).collect() == []
    rows = [(None, "q" * 250), (None, None), (4, "q" * 199)]
    got = P.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, got), key=str) == sorted(
        [
            (None, 250, 250, 1, nothing),
            (None, 0, 0, 0, nothing),
            (4, 199, 0, 0, hashlib.sha256(b"q" * 199).hexdigest()),
        ],
        key=str,
    )
    with pytest.raises(ValueError):
        P.remove_repeats(empty, length=3)
