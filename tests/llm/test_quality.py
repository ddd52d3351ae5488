"""Statistics, rule ensemble and decision list."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paragauge.llm import decision_list, rule_ensemble
from paragauge.llm import labels as L
from paragauge.llm import statistics as S
from paragauge.llm import words as W

ODD = [
    None, "", "\n\n a\n", "x", " ", "a b a b a b a b\n\nq\r\nq\r", "É é|", "one two three four five " * 3,
    "a\x0bb\x1cc d", "a\na\n a\na", "w " * 50_000, "#*$%&|<>!",
]


def brute(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(found[i : i + 5]) for i in range(len(found) - 4))
    covered = {
        j for i in range(len(found) - 4) if runs[tuple(found[i : i + 5])] > 1 for j in range(i, i + 5)
    }
    return {
        "n_words": len(found),
        "word_chars": sum(map(len, found)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_distinct": len(set(found)),
        "n_adjacent": sum(a == b for a, b in zip(found, found[1:])),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_digits": sum("0" <= c <= "9" for c in text),
        "n_marks": sum(c in "!?.,;:" for c in text),
        "n_chars": len(text),
    }


def texts():
    some = random.Random(2)
    made = ["".join(some.choice("abA1 \n\t#é,") for _ in range(some.randint(0, 80))) for _ in range(300)]
    return ODD + made


def test_counts_against_plain_python():
    got = S.count(pa.array(texts()))
    for i, text in enumerate(texts()):
        assert {c: int(got[c][i]) for c in S.COUNTS} == brute(text), repr(text)[:80]


def test_slices_and_codec(monkeypatch):
    monkeypatch.setattr(W, "SLICE_BYTES", 64)
    batch = pa.record_batch([pa.array(texts())], ["text"])
    parts = list(W.slices(batch))
    assert sum(p.num_rows for p in parts) == len(texts()) and len(parts) > 20
    for kind in (np.uint16, np.int32, np.uint64, np.float64):
        for n in (0, 1, 1000):
            x = np.arange(n).astype(kind) * 3
            assert (W.unpack(W.pack(x)) == x).all() and W.unpack(W.pack(x)).dtype == x.dtype


def corpus(spark, n=900):
    """Good and bad texts, and labels for two in three."""
    some = random.Random(4)
    words = ["w" + "".join(some.choice("aeioubcd") for _ in range(5)) for _ in range(3000)]
    rows, labels = [], []
    for i in range(n):
        text = " ".join(some.choice(words) for _ in range(some.randint(12, 200)))
        bad = i % 5 == 0
        if bad:
            kind = some.randrange(3)
            text = [text.upper(), (some.choice(words) + " ") * 80, text.replace(" ", " | ")][kind]
        rows.append((i, text, "good" if bad else "bad", 7))
        if i % 3:
            labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string, score int")
    labels += [(None, 1), (3, None), (6, 9)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_ensemble_learns_and_compiles(spark):
    docs, labels = corpus(spark)
    x, y = L.sample(docs, labels)
    assert len(y) > 300
    model = rule_ensemble.fit(x, y)
    assert 0 < len(model.rules) < 120
    rows = {r.doc_id: r for r in rule_ensemble.score(docs, model).collect()}
    assert len(rows) == 900
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    out = [i for i, r in rows.items() if r.held_out]
    assert np.mean([rows[i].predicted == int(i % 5 != 0) for i in out]) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    one = docs.limit(50).toPandas()
    counted = S.count(pa.array(one.text))
    share = lambda a, b: np.where(counted[b] > 0, counted[a] / np.maximum(counted[b], 1), 0.0)
    plain = np.column_stack(
        [share(*S.RATIOS[f]) if f in S.RATIOS else counted[f] for f in S.FEATURES]
    )
    assert np.allclose(model.predict(plain), [rows[i].score for i in one.doc_id])
    kept = rule_ensemble.keep(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def test_held_out_labels_are_not_learnt_from(spark):
    """With the opposite label on every held-out row the sample, and so the model, is the same."""
    docs, labels = corpus(spark)
    turned = spark.createDataFrame(
        [(r.doc_id, 1 - r.quality if r.quality in (0, 1) and r.doc_id is not None and not zlib.crc32(str(r.doc_id).encode()) % 5 else r.quality)
         for r in labels.collect()],
        "doc_id long, quality int",
    )
    assert turned.exceptAll(labels).count() > 50
    for one, other in zip(L.sample(docs, labels), L.sample(docs, turned)):
        assert np.array_equal(one, other)


def test_decision_list_learns_and_orders(spark):
    docs, labels = corpus(spark)
    rules = decision_list.train(docs, labels)
    assert rules.rules and all(rules.wording())
    got = {r.doc_id: r for r in decision_list.judge(docs, rules).collect()}
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    for i, r in got.items():
        w = want[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            w["n_words"], w["word_chars"], w["n_symbols"], w["n_dup_lines"], w["n_repeat_words"]
        )
        assert r.base_failed == (w["n_words"] < 10 or 100 * w["n_repeat_words"] > 20 * w["n_words"])
        assert r.kept == (not r.base_failed and r.rule is None)
    assert np.mean([got[i].kept for i in got if i % 5]) > 0.97
    assert np.mean([got[i].kept for i in got if i % 5 == 0]) < 0.05


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1), (3, 1)], [(None, 0), (1, None)]])
def test_few_or_odd_labels(spark, labels):
    docs = spark.createDataFrame(
        [(1, "a b"), (2, None), (3, ""), (None, "x"), (2, None)], "doc_id long, text string"
    )
    truth = spark.createDataFrame(labels, "doc_id long, quality int")
    scores = [r.score for r in rule_ensemble.score(docs, rule_ensemble.train(docs, truth)).collect()]
    assert len(scores) == 5 and len(set(scores)) == 1
    judged = decision_list.judge(docs, decision_list.train(docs, truth)).collect()
    assert len(judged) == 5 and not any(r.kept for r in judged)
    none = docs.where("false")
    assert rule_ensemble.score(none, rule_ensemble.train(none, truth)).collect() == []
    assert decision_list.judge(none, decision_list.DecisionList([])).collect() == []


def test_sample_is_bounded_by_ids(spark):
    docs = spark.createDataFrame([(3, f"a b {i}") for i in range(200)] + [(4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 0), (3, 1), (4, 0), (5, 1), (None, 1)], "doc_id long, quality int")
    x, y = L.sample(docs, labels)
    ids = [i for i in (3, 4) if zlib.crc32(str(i).encode()) % 5]
    assert len(x) == len(y) == len(ids) and sorted(y.tolist()) == sorted({3: 1, 4: 0}[i] for i in ids)
