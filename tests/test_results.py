import pytest
from pyspark.sql import functions as F

from paragauge.operators import results
from paragauge.plans import report

SCHEMA = "row_id long, model string, prediction string"
MODELS = ["org/a-0.5B", "org/a-0.5B-bnb-4bit(finetuned)", "b`c"]


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame(
        [(i, f"s{i}", f"the target number {i} is here") for i in range(6)],
        "row_id long, source string, target string",
    )


@pytest.fixture()
def predictions(spark):
    return spark.createDataFrame([(i, m, f"{m} says {i}") for i in range(6) for m in MODELS], SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pivot_and_unpivot_are_inverse(pairs, predictions):
    wide = results.pivot(pairs, predictions, MODELS)
    assert wide.columns == ["row_id", "source", "target", *MODELS]
    back = results.unpivot(wide).select("row_id", "model", "prediction")
    assert rows(back) == rows(predictions)


def test_wide_selection(pairs, predictions):
    wide = results.pivot(pairs, predictions, MODELS)
    assert results.model_columns(wide) == MODELS
    assert results.drop_columns_like(wide, "bnb-4bit").columns[3:] == [MODELS[0], MODELS[2]]
    assert results.drop_columns(wide, [MODELS[2], "none"], errors="ignore").columns[3:] == MODELS[:2]
    with pytest.raises(ValueError, match="none"):
        results.drop_columns(wide, ["none"])
    assert results.select_models(predictions, MODELS[:1]).count() == 6


def test_upsert_twice_is_upsert_once(spark, predictions):
    new = spark.createDataFrame([(0, MODELS[0], "new"), (9, "fresh", "x")], SCHEMA)
    once = results.upsert(predictions, new)
    assert rows(results.upsert(once, new)) == rows(once)
    assert once.count() == 19 and once.where("prediction = 'new'").count() == 1


def test_coverage(spark, pairs, predictions):
    results.require_coverage(pairs, predictions)
    faulty = (
        predictions.where("NOT (model = 'b`c' AND row_id < 2)")
        .unionByName(spark.createDataFrame([(77, MODELS[0], "o"), (3, MODELS[1], "d"), (3, MODELS[1], "d")], SCHEMA))
    )
    got = {r.model: (r.expected, r.present, r.missing, r.duplicates, r.orphans)
           for r in results.coverage(pairs, faulty).collect()}
    assert got == {MODELS[0]: (6, 6, 0, 0, 1), MODELS[1]: (6, 6, 0, 2, 0), "b`c": (6, 4, 2, 0, 0)}
    with pytest.raises(ValueError, match="line up"):
        results.require_coverage(pairs, faulty)
    with pytest.raises(ValueError):
        report.metrics(pairs, faulty)


def test_alignment_is_one_exchange_per_side(pairs, predictions):
    """Nothing but the two sides of the join and the final sums by model is shuffled."""
    plan = report.metrics(pairs, predictions, check=False)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange hashpartitioning(row_id") == 2
    assert initial.count("Exchange") == 3
    joined = results.align(pairs, predictions)._jdf.queryExecution().optimizedPlan().toString()
    assert "target_13a" not in joined and "regexp" not in joined
    below = initial[initial.index("Join") :]
    assert "target_13a" not in below and "target_words" not in below
    assert "Window" not in initial and "CartesianProduct" not in initial and "NestedLoop" not in initial


def test_wide_scores_need_no_join(pairs):
    stored = pairs.select(
        "row_id", "source", "target", *[F.concat("target", F.lit(m)).alias(m) for m in MODELS]
    )
    table = report.metrics_wide(stored)
    plan = table._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
    long = results.unpivot(stored)
    want = rows(report.metrics(pairs, long).drop("all_metrics"))
    for got, row in zip(rows(table.drop("all_metrics")), want, strict=True):
        assert got[0] == row[0] and got[1:] == pytest.approx(row[1:], abs=1e-12)


def test_unselected_scores_are_not_computed(pairs, predictions):
    table = report.metrics(pairs, predictions, check=False).select("model", "accuracy")
    assert "ArrowEvalPython" not in table._jdf.queryExecution().executedPlan().toString()


def test_metrics_of_a_copy(spark, pairs):
    copies = pairs.select("row_id", F.lit("org/copy").alias("model"), F.col("target").alias("prediction"))
    got = report.metrics(pairs, copies).first()
    assert (got.accuracy, got.bleu_1, got.rouge_l) == pytest.approx((1, 1, 1))
    assert got.meteor == pytest.approx(1 - 0.5 / 6**3)
    assert got.all_metrics.rouge_scores.rougeLsum == pytest.approx(1)


def test_describe_and_chart(spark):
    table = spark.createDataFrame(
        [("o/a", 0.0, 0.5, 0.25, 0.125), ("o/b", 1.0, 0.0, 0.75, 0.5), ("o/c", 0.5, 1.0, 0.5, 0.25)],
        "model string, accuracy double, meteor double, bleu_1 double, rouge_l double",
    )
    stats = {r.statistic: r for r in report.describe(table).collect()}
    assert stats["count"].accuracy == 3 and stats["std"].accuracy == pytest.approx(0.5)
    assert (stats["25%"].bleu_1, stats["50%"].bleu_1, stats["75%"].bleu_1) == pytest.approx((0.375, 0.5, 0.625))
    bars = report.chart_frame(table).collect()
    assert len(bars) == 8 and {b.label for b in bars} == {"METEOR", "BLEU-1", "ROUGE-L"}
    perf = spark.createDataFrame([("o/a", 10.0, 5.0, "g"), ("o/b", 0.0, 7.0, "g")], "model string, train_min double, eval_min double, gpu string")
    timed = report.perf_report(table, perf)
    assert {r.model_name: r.gpu for r in timed.collect()} == {"a": "g", "b": "g", "c": None}
    bounds = {(r.model, r.series): (r.bottom, r.top) for r in report.stacked_bounds(timed).collect()}
    assert bounds == {("o/a", "train_min"): (0, 10), ("o/a", "eval_min"): (10, 15), ("o/b", "eval_min"): (0, 7)}


def test_slice_reaches_the_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = results.row_slice(docs, 10, 20, key="doc_id")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,10)" in plan and part.count() == 10
    assert [r.doc_id for r in results.head(docs, 3, key="doc_id").collect()] == [0, 1, 2]
