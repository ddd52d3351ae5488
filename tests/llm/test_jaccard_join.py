"""The similarity join against all pairs in plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from paragauge.llm import jaccard_join as J
from paragauge.llm.components import connected


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(
        (str(key), len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)
    )


def corpus(seed=1, groups=25):
    some = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = [some.choice(vocab) for _ in range(60)]
    texts = [None, "", " \n ", "a", "A", "a b", "b a", "a b c d", "a b c d e", "x " * 50]
    for g in range(groups):
        base = [some.choice(vocab) for _ in range(some.choice([8, 30, 120, 300]))]
        if g % 4 == 0:
            base += passage
        for _ in range(some.choice([1, 1, 2, 6, 30])):
            copy = list(base)
            for _ in range(some.choice([0, 0, 1, 2, 5])):
                at = some.randrange(len(copy))
                what = some.randrange(3)
                if what == 0:
                    copy[at] = some.choice(vocab).upper()
                elif what == 1:
                    del copy[at]
                else:
                    copy.insert(at, some.choice(vocab))
                copy = copy or ["z"]
            texts.append(some.choice([" ", "\n", "\t"]).join(copy))
    texts.append(" ".join(some.choice(vocab) for _ in range(30_000)))
    some.shuffle(texts)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[20]), (rows[5][0], rows[5][1])]


def result(spark, rows, parts=3):
    docs = spark.createDataFrame(
        [(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n int, node int"
    ).repartition(parts)
    return sorted((str(r[0]), r[1], r[2]) for r in J.components(docs).collect())


def test_equals_all_pairs(spark):
    rows = corpus()
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("block,heavy", [(300, 10)])
def test_small_blocks_change_nothing(spark, monkeypatch, block, heavy):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "HEAVY", heavy)
    rows = corpus(seed=9, groups=14)
    assert result(spark, rows) == brute(rows)


def test_search_connects_what_links():
    some = random.Random(2)
    for _ in range(60):
        pool = [some.getrandbits(63) for _ in range(some.choice([6, 20, 60]))]
        sets = [
            np.array(sorted(set(some.choices(pool, k=some.randint(1, 40)))), np.uint64) for _ in range(25)
        ]
        forest, want = J.Forest(25), J.Forest(25)
        for a, b in J.search(sets):
            forest.join(a, b)
            assert J.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))
        for a in range(25):
            for b in range(a):
                if J.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                    want.join(a, b)
        assert [forest.find(x) for x in range(25)] == [want.find(x) for x in range(25)]


def test_heap_merge_counts_and_skips():
    some = random.Random(3)
    for _ in range(200):
        lists = [sorted(some.sample(range(60), some.randint(0, 30))) for _ in range(some.randint(1, 12))]
        flat = np.array([x for one in lists for x in one], np.int32)
        spans, at = [], 0
        for one in lists:
            spans.append((at, at + len(one)))
            at += len(one)
        least, low = some.randint(1, 8), some.randint(0, 20)
        want = {x: n for x in range(low, 60) if (n := sum(x in one for one in lists)) >= least}
        assert dict(J.merge_skip(memoryview(flat), spans, least, low)) == want


def near_copies(n):
    """Sets of 100, of which six are their own and the others those of the whole group."""
    some = np.random.default_rng(n)
    group = some.integers(0, 1 << 62, 94, dtype=np.uint64)
    return [np.sort(np.concatenate([group, some.integers(1 << 62, 1 << 63, 6, dtype=np.uint64)])) for _ in range(n)]


def test_group_of_near_copies_grows_in_proportion():
    taken = []
    for n in (1000, 2000, 4000):
        steps = []
        assert len(J.search(near_copies(n), steps)) == n - 1
        taken.append(sum(steps))
    assert taken[1] <= 2.1 * taken[0] and taken[2] <= 2.1 * taken[1]


def test_links_between_groups_are_found():
    """Two groups that share most of their lists hang together by one set in between."""
    some = np.random.default_rng(7)
    new = lambda n: some.integers(0, 1 << 63, n, dtype=np.uint64)
    both, left, right = new(72), new(26), new(26)
    sets = [np.sort(np.concatenate([both, left, new(2)])) for _ in range(30)]
    sets += [np.sort(np.concatenate([both, right, new(2)])) for _ in range(30)]
    apart = J.Forest(60)
    for a, b in J.search(sets):
        apart.join(a, b)
    assert {apart.find(x) for x in range(60)} == {apart.find(0), apart.find(59)} and apart.find(0) != apart.find(59)
    sets.append(np.sort(np.concatenate([both, left[:14], right[:14]])))
    together = J.Forest(61)
    for a, b in J.search(sets):
        together.join(a, b)
    assert len({together.find(x) for x in range(61)}) == 1


def edited_copies(n):
    """Sets with 70 to 97 of a hundred common shingles, and others of their own: most link with none."""
    some = np.random.default_rng(n)
    whole = some.integers(0, 1 << 62, 100, dtype=np.uint64)
    out = []
    for kept in some.choice([70, 80, 88, 90, 91, 92, 94, 97], n):
        own = some.integers(1 << 62, 1 << 63, 100 - kept, dtype=np.uint64)
        out.append(np.sort(np.concatenate([some.permutation(whole)[:kept], own])))
    return out


def test_edited_copies_that_do_not_link_are_seldom_compared():
    n, steps, found, want = 600, [], J.Forest(600), J.Forest(600)
    sets = edited_copies(n)
    for a, b in J.search(sets, steps):
        found.join(a, b)
    for a in range(n):
        for b in range(a):
            if J.linked(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), len(sets[a]), len(sets[b])):
                want.join(a, b)
    groups = {want.find(x) for x in range(n)}
    assert [found.find(x) for x in range(n)] == [want.find(x) for x in range(n)] and n // 4 < len(groups) < n
    assert sum(steps) < 5 * n * n


def near(sets):
    """Cluster of each set, of the sets as one task tells them."""
    order = J.Order(np.zeros(1 << J.SLOT_BITS - 2, np.uint8), np.empty(0, np.uint32), np.empty(0, np.uint8))
    n = np.array([len(s) for s in sets])
    keys, node, size = J._prefix(np.concatenate(sets), n, np.arange(len(sets)), order)
    table = pa.table(
        {"keys": [J.W.pack(keys)], "nodes": [bytes(8) + J.W.pack(node.astype(np.uint32))], "sizes": [J.W.pack(size)]}
    )
    forest = J.Forest(len(sets))
    for a, b in zip(*(x.tolist() for x in J._near(table))):
        forest.join(a, b)
    return [forest.find(x) for x in range(len(sets))]


def test_clusters_hold_all_links_and_little_else():
    some, links = random.Random(5), 0
    for _ in range(40):
        pool = [some.getrandbits(63) for _ in range(60)]
        sets = [np.array(sorted(some.sample(pool, some.randint(30, 56))), np.uint64) for _ in range(12)]
        label = near(sets)
        for a in range(12):
            for b in range(a):
                if J.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                    links += 1
                    assert label[a] == label[b]
    assert links > 100
    # Sets of 28 must share 24, so one of the first five; a common seventh one is of no use.
    one, other = np.arange(1, 29, dtype=np.uint64) * 10, np.arange(1, 29, dtype=np.uint64) * 10 + 5
    other[6] = one[6]
    assert near([one, other]) == [0, 1]
    assert near([one, one]) == [0, 0]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200)]
    got = {r.node: r.label for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each(spark):
    rows = corpus(groups=8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(str(r.doc_id) for r in J.one_of_each(docs).collect())
    want = [k for k, _, c in brute(rows) if k == str(c) or k == "None"]
    assert kept == sorted(want)


def test_empty_table(spark):
    assert J.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
