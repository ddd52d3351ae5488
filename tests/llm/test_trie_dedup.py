import hashlib
import random

from paragauge.llm import trie_dedup


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows():
    some = random.Random(3)
    base = ["", "a", "ab", "abc", "É", "é", "ABC" * 40_000] + [
        "".join(some.choice("abAB ") for _ in range(some.randint(1, 6))) for _ in range(80)
    ]
    made = [(i, some.choice(base)) for i in range(400)]
    return made + [(401, None), (None, "ab"), (7, made[7][1]), (7, made[7][1])]


def test_classes_against_groups(spark):
    data = rows()
    docs = spark.createDataFrame(
        [(i, t, 1, "y") for i, t in data], "doc_id long, text string, size int, rep string"
    ).repartition(5)
    groups = {}
    for i, t in data:
        groups.setdefault(lowered(t), []).append(i)
    want = []
    for i, t in data:
        group = groups[lowered(t)]
        keep = max((x for x in group if x is not None), default=None)
        sha = hashlib.sha256(lowered(t).encode()).hexdigest()
        want.append((i, keep, len(group), i == keep, sha))
    key = lambda r: str(r)
    got = [tuple(r) for r in trie_dedup.classes(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)

    kept = trie_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, lowered(r.text)) for r in kept.collect()), key=key) == sorted(
        ((max((x for x in g if x is not None), default=None), t) for t, g in groups.items()), key=key
    )


def test_buffers_and_spills_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    want = sorted(map(str, trie_dedup.classes(docs).collect()))
    monkeypatch.setattr(trie_dedup, "BUFFER_BYTES", 10)
    monkeypatch.setattr(trie_dedup, "TRIE_BYTES", 10)
    assert sorted(map(str, trie_dedup.classes(docs).collect())) == want


def test_trie_spills_by_subtree():
    trie = trie_dedup.Trie()
    texts = [b"", b"a", b"abc", b"abd", b"b", b"abcdef"]
    for i, text in enumerate(texts):
        trie.insert(text, bytes([i])).add((0, i), i, 1, None)
    assert trie.insert(b"abd", b"\x03").owner == 3
    assert sorted(t.owner for t in trie.spill(bytes([2]))) == [0, 1, 3, 4, 5]
    assert [t.owner for t in trie.spill(None)] == [2]
    assert not trie.root.children


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert trie_dedup.classes(docs).collect() == trie_dedup.deduplicate(docs).collect() == []
