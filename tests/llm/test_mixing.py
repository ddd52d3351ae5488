import math

import pytest

from paragauge.llm import mixing

TOKENS = {"big": 60_000, "mid": 9_000, "small": 1_000, None: 500, "none": 0}


def test_exponent_meets_entropy():
    plan = mixing.plan(TOKENS, entropy_share=0.8, budget=10_000)
    assert math.isclose(mixing.entropy(plan.weights), 0.8 * 2, rel_tol=1e-9)
    assert 0 < plan.exponent < 1 and plan.weights["none"] == 0
    assert abs(sum(plan.budgets.values()) - 10_000) <= 3


def test_exponent_meets_repetition_limit():
    plan = mixing.plan(TOKENS, repetitions=1.5)
    passes = {s: plan.budgets[s] / t for s, t in TOKENS.items() if t}
    assert math.isclose(max(passes.values()), 1.5, rel_tol=2e-3)
    assert math.isclose(passes["big"], 1.0, rel_tol=1e-3) and min(passes.values()) > 0.999
    with pytest.raises(ValueError):
        mixing.plan(TOKENS, repetitions=1.5, budget=200_000)


def test_limits_of_the_exponent():
    assert mixing.plan(TOKENS, budget=70_500).budgets["big"] == 60_000
    even = mixing.plan(TOKENS, entropy_share=1.0, budget=400)
    assert even.exponent < 1e-6 and even.budgets["small"] == 100
    assert mixing.plan({}).budgets == {} and mixing.plan({"a": 0}).budgets == {"a": 0}


def docs(spark):
    rows = [(i, "x " * (i % 7), "s" + str(i % 100 // 60)) for i in range(4000)]
    rows += [(9000 + i, "a b c", None) for i in range(200)] + [(None, None, "s0"), (5, "x", "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_budgets_are_met_in_blocks(spark):
    frame = docs(spark)
    tokens = dict(map(tuple, mixing.source_tokens(mixing.blocks(frame, "doc_id", "source", "text")).collect()))
    plan = mixing.plan(tokens, entropy_share=0.97, budget=12_000)
    rows = mixing.counted(frame, entropy_share=0.97, budget=12_000).collect()
    assert len(rows) == 4202
    for source, budget in plan.budgets.items():
        read = sum(len((r.text or "").split()) * r.copies for r in rows if r.source == source)
        block = max(
            sum(len((r.text or "").split()) for r in rows if (r.source, r.block) == (source, b))
            for b in range(mixing.BLOCKS)
        )
        assert abs(read - budget) <= block
    per_block = {}
    for r in rows:
        per_block.setdefault((r.source, r.block), set()).add(r.copies)
    assert all(len(c) == 1 and max(c) - min(c) == 0 for c in per_block.values())


def test_mix_reads_every_row_at_least_once(spark):
    frame = docs(spark)
    mixed = mixing.mix(frame, repetitions=1.5)
    assert mixed.columns == frame.columns
    got = mixed.groupBy("doc_id").count().collect()
    assert len(got) == 4201 and max(r["count"] for r in got if r.doc_id != 5) == 2


def test_empty_table(spark):
    none = docs(spark).where("false")
    assert mixing.mix(none, repetitions=2.0).collect() == []
    assert mixing.counted(none, entropy_share=0.9).collect() == []


def test_columns_named_like_the_result(spark):
    frame = docs(spark).selectExpr("*", "'mine' AS block", "7 AS copies", "1 AS source_")
    mixed = mixing.mix(frame, repetitions=1.5)
    assert mixed.columns == frame.columns
    assert {(r.block, r.copies) for r in mixed.select("block", "copies").distinct().collect()} == {("mine", 7)}
    rows = mixing.counted(frame, repetitions=1.5)
    assert rows.columns.count("block") == 1 and rows.agg({"copies": "max"}).first()[0] == 2


def test_any_number_of_sources(spark, monkeypatch):
    """30,000 sources, also by a join instead of a broadcast, against the plan by name."""
    rows = [(i, "w " * (i % 13 if i < 30_000 else 400), f"host-{i % 30_000}") for i in range(31_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = {}
    for _, text, source in rows:
        tokens[source] = tokens.get(source, 0) + len(text.split())
    want = mixing.plan(tokens, entropy_share=0.99, budget=300_000)
    got = []
    for told in (1 << 30, 1):
        monkeypatch.setattr(mixing, "TOLD_BLOCKS", told)
        counted = mixing.counted(frame, entropy_share=0.99, budget=300_000)
        got.append(sorted(map(tuple, counted.select("doc_id", "copies").collect())))
    assert got[0] == got[1] and len(got[0]) == 31_000
    copies, large = dict(got[0]), [s for s, t in tokens.items() if t >= 400]
    read = sum(len(text.split()) * copies[i] for i, text, source in rows if source in set(large))
    assert abs(read - sum(want.budgets[s] for s in large)) <= 400 * len(large)
    assert all(copies[i] == 1 for i, text, s in rows if tokens[s] == 0)
