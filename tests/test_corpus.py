import pytest
from pyspark.sql import functions as F

from paragauge.operators import corpus, prompts
from paragauge.operators.generate import generate, map_batches


@pytest.mark.parametrize("n", [0, 1, 5, 233, 1000])
def test_exact_split_sizes_and_sets(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    labelled = {r.row_id: r.split for r in corpus.split_exact(df).collect()}
    assert sum(s == "test" for s in labelled.values()) == -(-n // 5)
    again = {r.row_id: r.split for r in corpus.split_exact(df.repartition(9)).collect()}
    assert again == labelled


def test_exact_split_narrows_through_several_levels(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "row_id")
    want = {r.row_id for r in corpus.split_exact(df).where("split = 'test'").collect()}
    monkeypatch.setattr(corpus, "_DIGITS", 1)
    got = {r.row_id for r in corpus.split_exact(df).where("split = 'test'").collect()}
    assert got == want and len(want) == 600


@pytest.mark.parametrize("n", [50, 10_001])
def test_exact_split_refuses_heaps_of_one_id_and_null_ids(spark, n):
    df = spark.range(n).select(F.lit(7).cast("long").alias("row_id"))
    with pytest.raises(ValueError, match="unique"):
        corpus.split_exact(df)
    with pytest.raises(ValueError, match="null"):
        corpus.split_exact(df.select(F.lit(None).cast("long").alias("row_id")))


def test_labelling_is_narrow(spark):
    """Once the cut is known, the labelled table needs no exchange, sort or window."""
    df = spark.range(500).withColumnRenamed("id", "row_id")
    plan = corpus.split_exact(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan


def test_hash_split_share(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id")
    n = corpus.split_hash(df, fraction=0.3).where("split = 'test'").count()
    assert 1350 < n < 1650


def test_partition_check_counts_faults(spark):
    whole = spark.range(100).withColumnRenamed("id", "row_id")
    parts = corpus.split_hash(whole)
    assert tuple(corpus.split_partition_check(whole, parts).first()) == (0, 0, 0)
    faulty = parts.where("row_id >= 10").unionByName(
        spark.createDataFrame([(200, "test"), (50, "test"), (50, "train")], "row_id long, split string")
    )
    in_both, lost, invented = corpus.split_partition_check(whole, faulty).first()
    assert (in_both, lost, invented) == (1, 10, 3)


def test_filters(spark):
    rows = [(1, "a", "b"), (2, None, "b"), (3, "a", ""), (4, " ", " "), (5, "NA", "b")]
    df = spark.createDataFrame(rows, "row_id long, source string, target string")
    assert {r.row_id for r in corpus.nonempty(df).collect()} == {1, 4, 5}
    assert {r.row_id for r in corpus.nonempty(corpus.na_normalize(df)).collect()} == {1, 4}


def test_partition_check_is_one_aggregation(spark):
    whole = spark.range(50).withColumnRenamed("id", "row_id")
    plan = corpus.split_partition_check(whole, corpus.split_hash(whole))
    plan = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Range (") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_shards_follow_the_number_of_rows(spark):
    assert [corpus.shard_count(spark.range(n), 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]


def test_training_shards_hold_every_row_per_epoch(spark, tmp_path):
    df = spark.range(300).withColumnRenamed("id", "row_id")
    ordered = corpus.training_order(df, epochs=2, shards=4)
    corpus.write_training_shards(ordered, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.groupBy("epoch").agg(F.count_distinct("row_id").alias("n")).select("n").collect() == [(300,), (300,)]
    orders = [
        [r.row_id for r in ordered.where(f"epoch = {e}").orderBy("shuffle_key").collect()] for e in (0, 1)
    ]
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])
    one = spark.read.parquet(str(tmp_path / "t" / "epoch=0" / "shard=1"))
    keys = [r.shuffle_key for r in one.collect()]
    assert keys == sorted(keys)


def test_length_cap(spark):
    df = spark.createDataFrame([(1, "a b, c d"), (2, "a")], "id int, text string")
    got = {r.id: (r.n_tokens, r.truncated, r.capped) for r in corpus.length_cap(df, cap=3).collect()}
    assert got == {1: (5, True, "a b ,"), 2: (1, False, "a")}


def test_prompts(spark):
    df = spark.createDataFrame([(1, "你 {} 好", "hi")], "row_id long, source string, target string")
    chatml = prompts.with_prompts(df, prompts.TEMPLATES["chatml"], model="org/Qwen2").first()
    assert chatml.prompt == (
        f"<|im_start|>system\n{prompts.SYSTEM_MESSAGE}<|im_end|>\n<|im_start|>user\n"
        f"{prompts.INSTRUCTION}\n你 {{}} 好<|im_end|>\n<|im_start|>assistant\n"
    )
    assert chatml.text == chatml.prompt + "hi<|im_end|>"
    mistral = prompts.with_prompts(df, prompts.TEMPLATES["chatml"], model="x/MISTRAL-7b").first()
    assert "system" not in mistral.prompt
    inst = prompts.with_prompts(df, prompts.TEMPLATES["inst"], model="any").first()
    assert inst.prompt == f"<s>[INST] {prompts.INSTRUCTION}\n你 {{}} 好 [/INST]"


def test_conversation_has_one_row_per_turn(spark):
    rows = [(1, t + 4090, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(25)]
    df = spark.createDataFrame(rows + [(2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = prompts.render_conversations(df, prompts.TEMPLATES["llama3"]).orderBy("conv_id", "turn").collect()
    assert len(got) == 26
    assert [r.turn for r in got if r.text.startswith("<|begin_of_text|>")] == [4090, 0]
    assert [r.turn for r in got if r.text.endswith("assistant<|end_header_id|>\n\n")] == [4114, 0]


def test_generate_and_map_batches(spark):
    import numpy as np

    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "row_id long, prompt string")

    def load():
        return lambda asked: np.array([f"{p} assistant\nanswer to {p}<|im_end|>" for p in asked])

    got = {r.row_id: r.prediction for r in generate(df, load, "m", batch_size=3).collect()}
    assert got == {i: f"answer to p{i}" for i in range(20)}

    doubled = map_batches(df, lambda b: b[["row_id"]] * 2, "row_id long")
    assert sorted(r.row_id for r in doubled.collect()) == [2 * i for i in range(20)]
