"""Scores against plain re-computation, pair by pair."""

import hashlib
import math
import random
from collections import Counter
from itertools import accumulate
from math import ceil, exp, factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from paragauge.functions import overlap, text
from paragauge.functions.lcs import lcs_size, summary_hits
from paragauge.functions.porter import stem
from paragauge.operators import scoring, synonyms
from paragauge.operators.bootstrap import bootstrap_ci
from paragauge.operators.synonyms import pick_synonyms

WORDS = ["the", "cat", "cats", "sat", "sitting", "on", "mat", "mats", "dog", "running", "runs", "a"]


def random_pairs(count=80):
    rng = random.Random(11)

    def sentence(n):
        return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n"]) for _ in range(n))

    pairs = [(sentence(rng.randint(0, 18)), sentence(rng.randint(0, 18))) for _ in range(count)]
    return pairs + [(target, target + answer) for target, answer in pairs[:10]]


@pytest.fixture(scope="module")
def pairs():
    return random_pairs()


@pytest.fixture(scope="module")
def aligned(spark, pairs):
    rows = [(i, "m", target, answer) for i, (target, answer) in enumerate(pairs)]
    return spark.createDataFrame(rows, "row_id long, model string, target string, prediction string")


def scores(df, *columns):
    return [tuple(r) for r in df.orderBy("row_id").select(*columns).collect()]


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def f_score(hits, hyp, ref):
    return 2 * (hits / hyp) * (hits / ref) / (hits / hyp + hits / ref) if hits else 0.0


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def test_bleu(aligned, pairs):
    m, t, h, r = [0] * 4, [0] * 4, 0, 0
    for target, answer in pairs:
        ref, hyp = target.split(), answer.split()
        h, r = h + len(hyp), r + len(ref)
        for n in range(1, 5):
            m[n - 1] += sum((grams(hyp, n) & grams(ref, n)).values())
            t[n - 1] += max(len(hyp) - n + 1, 0)
    precisions = [a / b for a, b in zip(m, t)]
    penalty = 1.0 if h > r else math.exp(1 - r / h)
    want = penalty * math.exp(sum(map(math.log, precisions)) / 4)
    got = scoring.bleu(aligned).collect()[0].bleu_scores
    assert got.bleu == pytest.approx(want, abs=1e-12)
    assert got.precisions == pytest.approx(precisions, abs=1e-12)
    assert (got.translation_length, got.reference_length) == (h, r)


def test_bleu_of_empty_predictions_is_zero(spark):
    rows = [(0, "empty", "a b c d", ""), (1, "empty", "e f", None), (0, "copy", "a b c d", "a b c d")]
    df = spark.createDataFrame(rows, "row_id long, model string, target string, prediction string")
    got = {r.model: r.bleu_scores.bleu for r in scoring.bleu(df).collect()}
    assert got == {"empty": 0.0, "copy": 1.0}


def test_rouge(aligned, pairs):
    got = scores(
        scoring.with_rouge_l(scoring.with_rouge_n(aligned), summary=True),
        "rouge1", "rouge2", "rougeL", "rougeLsum",
    )
    for (target, answer), row in zip(pairs, got):
        ref, hyp = target.split(), answer.split()
        want = [
            f_score(sum((grams(hyp, n) & grams(ref, n)).values()), len(hyp) - n + 1, len(ref) - n + 1)
            for n in (1, 2)
        ]
        want.append(f_score(lcs_table(ref, hyp)[-1][-1], len(hyp), len(ref)))
        want.append(f_score(union_hits(target, answer), len(hyp), len(ref)))
        assert row == pytest.approx(want, abs=1e-12)


def union_hits(target, answer):
    """Sentence-level union of subsequences on the textbook table."""
    refs = [s.split() for s in target.split("\n") if s.split()]
    hyps = [s.split() for s in answer.split("\n") if s.split()]
    left_r, left_h = Counter(sum(refs, [])), Counter(sum(hyps, []))
    hits = 0
    for ref in refs:
        union = set()
        for hyp in hyps:
            table, i, j = lcs_table(ref, hyp), len(ref), len(hyp)
            while i and j:
                if ref[i - 1] == hyp[j - 1]:
                    i, j = i - 1, j - 1
                    union.add(i)
                elif table[i][j - 1] > table[i - 1][j]:
                    j -= 1
                else:
                    i -= 1
        for i in sorted(union):
            if left_r[ref[i]] and left_h[ref[i]]:
                left_r[ref[i]] -= 1
                left_h[ref[i]] -= 1
                hits += 1
    return hits


def test_single_line_summary_equals_whole_text():
    for target, answer in random_pairs(40):
        ref, hyp = target.split(), answer.split()
        assert summary_hits([ref], [hyp]) == lcs_size(ref, hyp) == lcs_table(ref, hyp)[-1][-1]


def test_long_sentences_walk_back_over_many_blocks():
    rng = random.Random(3)
    for _ in range(6):
        ref, hyp = rng.choices("abcdef", k=300), rng.choices("abcdef", k=250)
        assert summary_hits([ref], [hyp]) == lcs_size(ref, hyp) == lcs_table(ref, hyp)[-1][-1]
        target = " ".join(ref[:150]) + "\n" + " ".join(ref[150:])
        answer = " ".join(hyp[:90]) + "\n" + " ".join(hyp[90:])
        halves = [[s.split() for s in side.split("\n")] for side in (target, answer)]
        assert summary_hits(*halves) == union_hits(target, answer)


def scan_from_end(hyp, ref, same):
    """Greedy matching of (position, word) lists, both scanned from the end."""
    found = []
    for i in range(len(hyp) - 1, -1, -1):
        for j in range(len(ref) - 1, -1, -1):
            if same(hyp[i][1], ref[j][1]):
                found.append((hyp.pop(i)[0], ref.pop(j)[0]))
                break
    return found


def meteor(target, answer, stages):
    hyp, ref = list(enumerate(answer.split())), list(enumerate(target.split()))
    h, r, found = len(hyp), len(ref), []
    for key, same in stages:
        hyp = [(i, key(w)) for i, w in hyp]
        ref = [(i, key(w)) for i, w in ref]
        found += scan_from_end(hyp, ref, same)
    found.sort()
    if not found:
        return 0, 0, 0.0
    m = len(found)
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(found, found[1:]))
    p, q = m / h, m / r
    return m, chunks, (1 - 0.5 * (chunks / m) ** 3) * p * q / (0.9 * p + 0.1 * q)


def equal(a, b):
    return a == b


EXACT = (str, equal)
STEM = (stem, equal)


@pytest.mark.parametrize("by_stem", [False, True])
def test_meteor(aligned, pairs, by_stem):
    got = scores(scoring.with_meteor(aligned, stem=by_stem), "matched", "chunks", "meteor")
    stages = [EXACT, STEM] if by_stem else [EXACT]
    for (target, answer), row in zip(pairs, got):
        assert row == pytest.approx(meteor(target, answer, stages), abs=1e-12)


def test_synonyms_of_rows_with_one_key_do_not_mix(spark):
    rows = [(1, "m", "x dog", "z cat"), (1, "m", "foo bar", "baz qux"), (2, None, "dog", "cat")]
    df = spark.createDataFrame(rows, "row_id long, model string, target string, prediction string")
    table = spark.createDataFrame([("cat", "dog")], "word string, alt string")
    aligned = df.withColumns(text.reference_tokens(F.col("target")))
    got = {(r.row_id, r.target): r.matched for r in scoring.with_meteor(aligned, synonyms=table).collect()}
    assert got == {(1, "x dog"): 1, (1, "foo bar"): 0, (2, "dog"): 1}


def test_meteor_synonyms(spark, aligned, pairs):
    table = [("cat", "dog"), ("dog", "cat"), ("the", "a"), ("a", "on"), ("sat", "mat"), ("mat", "sat"),
             ("run", "dog"), ("on", "the"), ("on", "run")]
    alternatives = {}
    for word, alt in table:
        alternatives.setdefault(word, {word}).add(alt)
    stage = (str, lambda a, b: b in alternatives.get(a, {a}))
    df = spark.createDataFrame(table, "word string, alt string")
    got = scores(scoring.with_meteor(aligned, synonyms=df), "matched", "chunks", "meteor")
    for (target, answer), row in zip(pairs, got):
        assert row == pytest.approx(meteor(target, answer, [EXACT, STEM, stage]), abs=1e-12)


def test_synonyms_in_many_blocks(spark, aligned, pairs, monkeypatch):
    """Blocks of a few words give the same matches; copied and null ids do not multiply."""
    monkeypatch.setattr(synonyms, "BLOCK_WORDS", 4)
    table = [("cat", "dog"), ("the", "a"), ("a", "on"), ("sat", "mat"), ("on", "run"), ("on", "run"), (None, "a"), ("a", None)]
    alternatives = {}
    for word, alt in table:
        alternatives.setdefault(word, {word}).add(alt)
    stage = (str, lambda a, b: b in alternatives.get(a, {a}))
    df = spark.createDataFrame(table, "word string, alt string")
    rows = aligned.withColumn("row_id", F.when(F.expr("row_id % 3 <> 0"), F.col("row_id")))
    got = scoring.with_meteor(rows.unionAll(rows), synonyms=df).groupBy("target", "answer", "matched", "chunks").count().collect()
    want = Counter()
    for target, answer in pairs:
        want[target, answer, *meteor(target, answer, [EXACT, STEM, stage])[:2]] += 2
    assert {tuple(r)[:4]: r["count"] for r in got} == want


def test_alternatives_do_not_meet_rows_one_by_one(spark):
    """No join or group has a row's key beside an alternative: these are many times the text."""
    rows = [(i, "m", "w v x", "a b c") for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, model string, target string, prediction string")
    table = spark.createDataFrame([(w, a) for w in "abc" for a in "vwxyz"], "word string, alt string")
    out = scoring.with_meteor(df, synonyms=table)
    assert [r.matched for r in out.collect()] == [3] * 20
    nodes, names = [out._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() in ("Join", "Aggregate"):
            names.append({node.output().apply(i).name() for i in range(node.output().size())})
    assert names and not any("_key" in found and found & {"alt", "word"} for found in names)


def test_pick_synonyms_takes_the_last_free_place():
    picked = pick_synonyms([(0, "x"), (2, "x"), (2, "y")], ["x", "y", "x"])
    assert [(p >> 32, p & 0xFFFFFFFF) for p in picked] == [(0, 0), (2, 2)]


def test_identical_pair(spark):
    row = [(1, "m", "one two three four five", "one two three four five")]
    df = spark.createDataFrame(row, "row_id long, model string, target string, prediction string")
    all_scores = scoring.with_meteor(scoring.with_rouge_l(scoring.with_rouge_n(df), summary=True))
    got = scores(all_scores, "rouge1", "rouge2", "rougeL", "rougeLsum", "meteor")[0]
    assert got == pytest.approx((1, 1, 1, 1, 1 - 0.5 / 5**3), abs=1e-12)


def test_slices_do_not_change_results(aligned, monkeypatch):
    """A batch worked off in many slices, some of one row, gives the same counts."""
    import numpy as np
    import pyarrow as pa

    rows = [(a.split(), t.split()) for t, a in random_pairs(50)]
    hyp, ref = (pa.array(side, pa.list_(pa.string())) for side in zip(*rows))
    whole = overlap._order_matches(overlap._Tokens(hyp, ref), 4)
    monkeypatch.setattr(overlap, "SLICE_TOKENS", 20)
    slices = list(overlap._slices(hyp, ref))
    assert len(slices) > 10 and sum(len(h) for h, _ in slices) == 60
    parts = [overlap._order_matches(overlap._Tokens(h, r), 4) for h, r in slices]
    assert np.array_equal(np.concatenate(parts), whole)


def test_accuracy_and_ids(spark):
    rows = [(1, "m", "yes", "yes"), (2, "m", "yes", "Yes"), (3, "m", "", None), (4, "m", "ok", "x assistant\nok")]
    df = spark.createDataFrame(rows, "row_id long, model string, target string, prediction string")
    got = scoring.exact_match(df).collect()[0]
    assert (got.n, got.correct, got.accuracy) == (4, 3, 0.75)
    assert {r.row_id for r in scoring.exact_match_ids(df).collect()} == {1, 3, 4}


def test_bootstrap_surrounds_the_mean_and_repeats(spark):
    df = spark.range(400).select(
        F.col("id").alias("row_id"), F.lit("m").alias("model"), (F.col("id") % 10 / 10).alias("score")
    )
    first = bootstrap_ci(df, "score", replicates=200).collect()
    again = bootstrap_ci(df.repartition(7), "score", replicates=200).collect()[0]
    assert tuple(first[0])[1:] == pytest.approx(tuple(again)[1:], abs=1e-12)
    assert first[0].low < first[0].mean < first[0].high
    spread = (first[0].high - first[0].low) / 2
    assert spread == pytest.approx(1.96 * 0.2872 / 20, rel=0.25)
    with pytest.raises(ValueError):
        bootstrap_ci(df, "score", replicates=10)


def test_bootstrap_against_plain_python(spark):
    some = random.Random(5)
    rows = [(i, m, some.random()) for i in range(700) for m in ("a", "b") if some.random() < 0.8]
    rows += [(3, "a", None), (None, "b", 0.5)]
    limits = [ceil(p * 2**32) for p in accumulate(exp(-1) / factorial(k) for k in range(7))]

    def weight(row_id, rep):
        key = f"17|{rep // 4}" if row_id is None else f"17|{rep // 4}|{row_id}"
        part = hashlib.md5(key.encode()).hexdigest()[8 * (rep % 4) : 8 * (rep % 4) + 8]
        return sum(int(part, 16) >= limit for limit in limits)

    df = spark.createDataFrame(rows, "row_id long, model string, score double").repartition(3)
    for got in bootstrap_ci(df, "score", replicates=40).collect():
        own = [(i, s or 0.0) for i, m, s in rows if m == got.model]
        means = []
        for rep in range(40):
            drawn = [(weight(i, rep), s) for i, s in own]
            means.append(sum(w * s for w, s in drawn) / sum(w for w, _ in drawn))
        want = [sum(s for _, s in own) / len(own), *np.quantile(means, [0.025, 0.5, 0.975])]
        assert tuple(got)[1:] == pytest.approx(want, abs=1e-12)
