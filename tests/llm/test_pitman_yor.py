import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paragauge.llm import pitman_yor as P
from paragauge.llm import words as W
from paragauge.session import scratch_path


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def rows(n=300):
    some = random.Random(1)
    follow = {w: some.sample("abcdefghijklmnopqrst", 3) for w in "abcdefghijklmnopqrst"}
    out = []
    for i in range(n):
        w = some.choice(list(follow))
        text = []
        for _ in range(some.randint(0, 60)):
            text.append(w * some.choice([1, 1, 2]))
            w = some.choice(follow[w])
        out.append((i, " ".join(text)))
    return out + [(900, None), (901, " \n"), (902, "Zz ÉÉ new"), (None, "a b"), (3, out[3][1]), (950, "a b " * 40_000)]


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows()], "doc_id long, text string, score double, id int")
    return P.score(docs.repartition(3)).collect()


def test_base_against_counts(scored):
    data = rows()
    cut = {
        (i, t): re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + ["\0"]
        for i, t in data
    }
    counts = Counter()
    for i, t in data:
        if i is not None and not held(i):
            counts.update(cut[i, t])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), held(i), len(w), sum(counts[x] > 0 for x in w), n,
         round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))
        for (i, t) in data for w in [cut[i, t]]
    )
    got = sorted(
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored
    )
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9, atol=1e-6)


def test_model_beats_single_words_on_held_out(spark, scored):
    out = [r for r in scored if r.held_out]
    assert out and sum(r.score for r in out) > 0.8 * sum(r.base_score for r in out)
    assert all(r.score < 0 for r in scored)
    frame = spark.createDataFrame(scored)
    for r in P.perplexity(frame, "held_out").collect():
        assert 1 < r.perplexity < 60


CONTEXTS = 2049


def one_range():
    some = np.random.default_rng(3)
    pairs = np.unique(some.integers(0, 12, 80) * CONTEXTS + some.integers(0, 4, 80))
    counts = some.geometric(0.05, len(pairs)).astype(np.int64)
    words = np.arange(12, dtype=np.uint64)[: pairs.max() // CONTEXTS + 1]
    return P.Range(0, W.pack(words), W.pack(pairs), W.pack(counts), CONTEXTS), len(words)


def totals(own):
    per = np.bincount(own.context, own.tables, minlength=CONTEXTS).astype(np.int64)
    return P.Totals(per, int(own.customers.sum()), int(own.parent_tables.sum()))


def test_probabilities_sum_to_one_after_every_sweep():
    own, known = one_range()
    for sweep in range(4):
        now = totals(own)
        parent, rest = own.parent(now, known), P.unknown(now, known)
        assert math.isclose(parent.sum() + rest, 1, rel_tol=1e-12)
        discount, strength = P.CONTEXT_RULE
        for context in range(4):
            here = own.context == context
            whole = strength + own.counts[here].sum()
            onward = (strength + discount * now.tables[context]) / whole
            mine = ((own.counts - discount * own.tables)[here] / whole).sum()
            assert math.isclose(mine + onward, 1, rel_tol=1e-12)
        assert (own.tables >= 1).all() and (own.tables <= own.counts).all()
        assert (own.parent_tables <= own.customers).all()
        own.sweep(sweep, now, known)


def test_seating_follows_the_rule_customer_by_customer():
    seeds, some = W.mix(np.arange(4000, dtype=np.uint64)), random.Random(1)
    for customers, base, others in ((5, 0.3, 10), (40, 0.01, 500), (300, 0.2, 50)):
        fast = P.seat(np.full(4000, customers), np.full(4000, base), np.full(4000, others), (0.7, 5.0), seeds)
        slow = []
        for _ in range(1500):
            t = 1
            for n in range(1, customers):
                new = (5.0 + 0.7 * (others + t)) * base
                t += some.random() < new / (new + n - 0.7 * t)
            slow.append(t)
        assert abs(fast.mean() - np.mean(slow)) < 0.06 * np.mean(slow)
        assert 0.7 < fast.std() / np.std(slow) < 1.4


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.score(none).collect() == []
    out = next(i for i in range(100) if held(i))
    (row,) = P.score(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).collect()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.base_score) == (0, 0, 3, 0.0)
    assert math.isclose(row.score, 0, abs_tol=1e-6)


def test_contexts_are_words_not_their_shapes(spark):
    """Words of one first byte, ending and length class before different words."""
    follow = {"heating": "oil", "hunting": "deer", "housing": "rent", "жара": "юг", "жгра": "лёд"}
    some = random.Random(5)
    texts = [" ".join(f"{w} {follow[w]}" for w in some.choices(list(follow), k=40)) for _ in range(200)]
    mixed = [i for i in range(1000, 1100) if held(i)][:2]
    probe = [(mixed[0], " ".join(f"{w} {f}" for w, f in follow.items())),
             (mixed[1], " ".join(f"{w} {f}" for w, f in zip(follow, [*follow.values()][1:] + ["oil"])))]
    docs = spark.createDataFrame([*enumerate(texts), *probe], "doc_id long, text string")
    got = {r.doc_id: r.score for r in P.score(docs).where("doc_id >= 1000").collect()}
    assert got[mixed[0]] - got[mixed[1]] > 5 * 1.5


def test_contexts_have_no_bound_and_are_counted_over_all_ranges(spark):
    """More contexts than one fixed table holds, spread over all ranges of words."""
    data = [(i, f"c{i % 5000} w{i % 50} c{i % 5000} w{i % 49}") for i in range(6000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    store = scratch_path(spark, "test")
    P.encoded(docs, "doc_id", "text").write.parquet(f"{store}/blocks")
    blocks = spark.read.parquet(f"{store}/blocks")
    P.merged(P.messages(blocks, 4)).write.parquet(f"{store}/state")
    state = spark.read.schema(P._STATE).parquet(f"{store}/state")
    learnt = P.learn(state, store, 4)
    want = Counter()
    for i, text in data:
        if not held(i):
            want.update([P.START, *text.split()])
    hashes = {s.bucket: P._rising(s.contexts) for s in state.collect()}
    tables, customers = Counter(), {}
    own = spark.read.parquet(f"{store}/sent-{P.SWEEPS}").where("span IS NULL").collect()
    told = spark.read.parquet(f"{store}/sums-{P.SWEEPS}").orderBy("bucket", "span").collect()
    pairs = {s.bucket: P._rising(s.pairs).astype(np.int64) for s in state.collect()}
    for r in own:
        for c, t in zip(hashes[r.bucket][pairs[r.bucket] % len(hashes[r.bucket])], W.unpack(r.tables)):
            tables[c] += t
    for b, names in hashes.items():
        mine = [r for r in told if r.bucket == b]
        sums = np.concatenate([W.unpack(r.tables) for r in mine])
        assert [tables[c] for c in names] == sums.tolist()
        customers |= dict(zip(names.tolist(), np.concatenate([W.unpack(r.customers) for r in mine]).tolist()))
    assert sum(n > 0 for n in customers.values()) == len(want) > 2048
    assert sorted(n for n in customers.values() if n) == sorted(want.values())
    assert learnt.n_train == sum(want.values())


def test_draws_follow_the_binomial_distribution():
    u = P.uniform(W.mix(np.arange(20_000, dtype=np.uint64)), 3)
    assert abs(u.mean() - 0.5) < 0.01 and 0 <= u.min() and u.max() < 1
    for n, p in ((1, 0.3), (16, 0.05), (256, 0.4), (256, 1.0)):
        drawn = P.binomial(np.full(len(u), n), np.full(len(u), p), u)
        assert abs(drawn.mean() - n * p) < 0.05 * n * p + 0.02
        assert abs(drawn.var() - n * p * (1 - p)) < 0.05 * n * p * (1 - p) + 0.05


def test_scores_do_not_depend_on_the_number_of_ranges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).cache()
    usual, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 5):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(map(tuple, P.score(docs).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
        docs.unpersist()
    assert got[0] == got[1]


def test_own_tables_are_taken_out_of_the_parent():
    """For each pair as if the parent's counts were made without it."""
    own, known = one_range()
    for sweep in range(2):
        own.sweep(sweep, totals(own), known)
    now, (discount, strength) = totals(own), P.PARENT_RULE
    for i, chance in enumerate(own.parent_without(now, known)):
        w = own.word[i]
        customers = own.customers[w] - own.tables[i]
        tables = min(own.parent_tables[w], customers)
        rest = now.parent_tables - own.parent_tables[w] + tables
        whole = strength + now.customers - own.tables[i]
        want = (customers - discount * tables) / whole + (strength + discount * rest) / whole / (known + 1)
        assert math.isclose(chance, want, rel_tol=1e-12)
        assert chance <= own.parent(now, known)[w] + 1e-12
