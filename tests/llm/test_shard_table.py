from collections import Counter

import pytest

from paragauge.llm import shard_table

SHARDS = [f"s{i}" for i in range(13)]


def test_table_is_even_and_stable():
    owner = shard_table.fill(SHARDS, 1009)
    sizes = Counter(owner)
    assert set(sizes) == set(range(13)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = shard_table.fill(SHARDS[:-1], 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 12)
    assert moved < 0.1 * 1009


def test_place(spark):
    docs = spark.createDataFrame(
        [(i, "t") for i in range(2000)] + [(None, None), (5, "again")], "doc_id long, text string"
    )
    got = shard_table.place(docs, SHARDS)
    rows = got.collect()
    assert len(rows) == 2002 and got.columns == ["slot", "doc_id", "text", "shard"]
    owner = shard_table.fill(SHARDS)
    assert all(r.shard == SHARDS[owner[r.slot]] for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 5}) == 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan


def test_refusals(spark):
    with pytest.raises(ValueError):
        shard_table.fill(SHARDS, 1000)
    with pytest.raises(ValueError):
        shard_table.fill(["a", "a"])
    with pytest.raises(ValueError):
        shard_table.place(spark.range(1).selectExpr("id AS doc_id", "1 AS slot"), SHARDS)


def test_write(spark, tmp_path):
    docs = spark.range(100).selectExpr("id AS doc_id", "'x' AS text")
    shard_table.write_shards(docs, str(tmp_path / "out"), SHARDS)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
