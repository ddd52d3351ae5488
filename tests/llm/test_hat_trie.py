"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from paragauge.llm import hat_trie as C


def brute(rows, least, top):
    upper = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    count = {}
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(upper)):
            words = re.findall(r"[^ \t]+", piece)
            here = count.setdefault(lang or "und", Counter())
            for size in (1, 2, 3):
                here.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in count.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            inside = [b for q, b in found.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * b >= 50 * a for b in inside):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def table(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [*"abcdefgh", "Don't", "ÉT", "x y", "日本", "zz\x1f"]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ", ", "\n", "!\r", "\t"]) for _ in range(rng.randint(0, 60))]
        rows.append((" ".join(words), rng.choice(["en", "de", None, "und"])))
    rows += [("New York City is near. New York City is far.", "en")] * 9 + [(None, "en"), ("", None), (" .,; \n", "fr")]
    return rows


@pytest.mark.parametrize("seed,least,top", [(1, 2, 1000), (2, 4, 7)])
def test_equals_plain_counting(spark, seed, least, top):
    rows = table(seed)
    docs = spark.createDataFrame([(i, t, g, "x") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, word string")
    got = C.collocations(docs.repartition(3), least=least, top=top).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, top)


@pytest.mark.parametrize("base", [40, 3_000_000])  # the second needs more than 64 bits
def test_trie_bursts_and_spills(base):
    rng = np.random.default_rng(base)
    trie = C.HatTrie(base, container=50, held=900)
    runs, want = [], Counter()
    for _ in range(30):
        ids = np.where(rng.random(400) < 0.1, 0, rng.zipf(1.3, 400) % (base - 1) + 1)
        for part in C.phrases(ids, base):
            want.update(int(p) for p in part)
            runs += trie.insert(part)
            assert trie.held == sum(map(len, trie.leaves)) <= 900 + 2 * 400
    assert len(trie.leaves) > 5 and trie.lows == sorted(set(trie.lows))
    assert all(low % base == 0 for low in trie.lows)  # containers begin at a prefix
    runs.append(trie.spill(trie.held))
    assert trie.held == 0 and len(runs) > 2
    for found, _ in runs:
        assert all(a < b for a, b in zip(found, found[1:]))
    back = []
    for found, counts in runs:
        for part in C.dealt(found, counts, base, 7):
            back.append((part["bucket"], C.unpack_phrases(part["phrases"], base), C.W.unpack(part["counts"]).astype(np.int64)))
    merged = {}
    for bucket in {b for b, _, _ in back}:
        found, total = C.merge([(p, c) for b, p, c in back if b == bucket], 2)
        assert not set(found.tolist()) & set(merged)
        merged |= dict(zip(found.tolist(), total.tolist()))
    assert merged == {p: c for p, c in want.items() if c >= 2}


def test_phrases_do_not_depend_on_slices(monkeypatch):
    ids = np.random.default_rng(1).integers(0, 5, (1 << 18) + 77)
    got = Counter(int(p) for part in C.phrases(ids, 5) for p in part)
    want = Counter()
    ids = [*ids.tolist(), 0, 0]
    for x, a, b in zip(ids, ids[1:], ids[2:]):
        if x and a:
            want[(x * 5 + a) * 5] += 1
            if b:
                want[(x * 5 + a) * 5 + b] += 1
    assert got == want


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 10**14 + 7
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 3).alias("l"), F.lit(3 * big).alias("r"))
    got = row.select(C.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first().s
    assert got == 1_000_000 * big * big // ((big + 3) * 3 * big)


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("a b c", "en")]):
        out = C.collocations(spark.createDataFrame(rows, "text string, lang string"))
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.collect() == []
