"""Bucketed stores: joins without an exchange, and upserts of some rows."""

import pytest
from pyspark.sql import functions as F

from paragauge.operators.results import align
from paragauge.sources import bucketed


def pairs(spark, n):
    return spark.range(n).selectExpr("id AS row_id", "concat('s', id) AS source", "concat('t', id) AS target")


def predicted(spark, ids, model, value):
    rows = [(i, f"{value}{i}", model) for i in ids]
    return spark.createDataFrame(rows, "row_id long, prediction string, model string")


@pytest.fixture()
def stores(spark, tmp_path):
    left = bucketed.pairs_store(str(tmp_path / "pairs"), 4)
    right = bucketed.predictions_store(str(tmp_path / "predictions"), 4)
    bucketed.write(pairs(spark, 40), left)
    bucketed.write(predicted(spark, range(40), "org/a.1", "a").union(predicted(spark, range(30), "b", "b")), right)
    return left, right


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_between_stored_sides(spark, stores):
    left, right = (bucketed.read(spark, s) for s in stores)
    both = align(left, right)
    assert "Exchange" not in plan(both) and "Join" in plan(both)
    assert both.count() == 70
    new = bucketed.write(predicted(spark, [1], "b", "n"), bucketed.predictions_store(stores[1].path + "-new", 4))
    kept = bucketed.upserted(right.where("model = 'b'"), new)
    assert "Exchange" not in plan(kept) and "SortMergeJoin" in plan(kept)


def test_upsert_of_some_rows(spark, stores):
    _, store = stores
    new = predicted(spark, [3, 35], "b", "new").union(predicted(spark, [3], "c", "c"))
    for _ in range(2):  # twice is once
        got = {(r.row_id, r.model): r.prediction for r in bucketed.upsert(spark, store, new).collect()}
        want = {(i, "org/a.1"): f"a{i}" for i in range(40)} | {(i, "b"): f"b{i}" for i in range(30)}
        assert got == want | {(3, "b"): "new3", (35, "b"): "new35", (3, "c"): "c3"}
    # Still bucketed: an aggregate on the key needs no exchange.
    assert "Exchange" not in plan(bucketed.read(spark, store).groupBy("row_id").count())


def test_only_touched_models_are_written(spark, stores, tmp_path):
    def files(part):
        return sorted(p.name for p in (tmp_path / "predictions" / part).iterdir() if p.suffix == ".parquet")

    before = files("model=org%2Fa.1"), files("model=b")
    bucketed.upsert(spark, stores[1], predicted(spark, [0], "b", "x"))
    assert files("model=org%2Fa.1") == before[0] and files("model=b") != before[1]


def test_two_new_predictions_for_one_row_are_refused(spark, stores):
    twice = predicted(spark, [7], "b", "x").union(predicted(spark, [7], "b", "y"))
    with pytest.raises(Exception, match="more than one new prediction for row 7"):
        bucketed.upsert(spark, stores[1], twice)
    assert bucketed.read(spark, stores[1]).where("row_id = 7 AND model = 'b'").first().prediction == "b7"


def test_another_session_finds_the_store(spark, stores):
    for store, n in zip(stores, (40, 70)):
        spark.sql(f"DROP TABLE {store.name}")
        again = bucketed.read(spark, store)
        assert again.count() == n
        assert "Exchange" not in plan(again.groupBy("row_id").agg(F.count("*")))
    with pytest.raises(FileNotFoundError):
        bucketed.read(spark, bucketed.pairs_store(stores[0].path + "-none", 4))
