from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge import schemas
from paragauge.operators import corpus
from paragauge.plans.prepare import evaluate, prepare
from paragauge.operators.prompts import TEMPLATES
from paragauge.sources import delimited, tables
from paragauge.sources.dialogue import pairs_from_turns

TWO = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
FAULTY = (
    'a{0}b\n1{0}2\n"x\ny"{0}"q""r"\nshort\n1{0}2{0}3\n1{0}2{0}{0}\n1{0}2{0}\n'
    '"a{0}b{0}c"{0}2\n s {0}NA\n{0}z\n""{0}e\n1{0}2{0}{0}4\n'
)
SURVIVORS = {
    ("1", "2"), ("x\ny", 'q"r'), ("short", None), (" s ", "NA"), (None, "z"), ("", "e"),
}


def test_bad_lines_are_set_aside(spark, tmp_path):
    for name, sep in (("c.csv", ","), ("t.tsv", "\t")):
        path = tmp_path / name
        path.write_text(FAULTY.format(sep))
        good, rejected = delimited.read_skipping_bad_lines(spark, str(path), TWO, sep)
        assert {tuple(r) for r in good.collect()} == SURVIVORS | {(f"a{sep}b{sep}c", "2")}
        assert len(rejected.collect()) == 4


def test_round_trip_keeps_every_character(spark, tmp_path):
    rows = [("a\tb", 'say "hi"'), ("line\nend", "  padded  "), ("", None), (None, ""), ("NA", "é好"), ("a,b", "\\")]
    df = spark.createDataFrame(rows, TWO)
    for sep in (",", "\t"):
        path = str(tmp_path / f"out{ord(sep)}")
        delimited.write_delimited(df, path, sep)
        assert {tuple(r) for r in delimited.read_delimited(spark, path, TWO, sep).collect()} == set(rows)
        na = delimited.read_delimited(spark, path, TWO, sep, na="pandas")
        assert na.where("a IS NULL").count() == 3


def test_row_ids_follow_file_order(spark, tmp_path):
    for i, names in enumerate((["b", "c"], [], ["d"] * 50, ["e", "f"])):
        lines = ["a\tb", *(f"{n}\t{k}" for k, n in enumerate(names))]
        (tmp_path / f"part-{i}.tsv").write_text("\n".join(lines) + "\n")
    scan = delimited.read_delimited(spark, str(tmp_path), TWO)
    rows = sorted((r.row_id, r.a, int(r.b)) for r in delimited.with_row_id(scan).collect())
    want = [("b", 0), ("c", 1), *(("d", k) for k in range(50)), ("e", 0), ("f", 1)]
    assert rows == [(i, *w) for i, w in enumerate(want)]


def test_row_ids_of_split_files(spark, tmp_path):
    """Splits of a file land in tasks in any order; numbers follow the file all the same."""
    for name, n in (("p", 301), ("q", 120)):
        lines = ["a\tb", *(f"{name}{i}\t{i}" for i in range(n))]
        (tmp_path / f"{name}.tsv").write_text("\n".join(lines) + "\n")
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        scan = delimited.read_delimited(spark, str(tmp_path), TWO, multi_line=False)
        assert scan.rdd.getNumPartitions() > 5
        rows = sorted((r.row_id, r.a) for r in delimited.with_row_id(scan).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    want = [f"p{i}" for i in range(301)] + [f"q{i}" for i in range(120)]
    assert rows == list(enumerate(want))


def test_materialize_keeps_the_first_result(spark, tmp_path):
    path, built = str(tmp_path / "once"), []

    def build(n):
        built.append(n)
        return spark.range(n).select(
            F.col("id").alias("row_id"), F.lit("s").alias("source"), F.lit("t").alias("target"),
            F.lit("train").alias("split"),
        )

    for n in (3, 5):
        got = tables.materialize(spark, path, lambda n=n: build(n), schemas.SPLIT_CORPUS, ["split"])
        assert got.count() == 3
    assert built == [3]
    (tmp_path / "once" / "_SUCCESS").unlink()  # a broken-off write is done again
    again = tables.materialize(spark, path, lambda: build(4), schemas.SPLIT_CORPUS, ["split"])
    assert again.count() == 4


def test_materialize_needs_every_part(spark, tmp_path):
    path, parts = str(tmp_path / "once"), ["split=train", "split=test"]
    row = spark.range(1).selectExpr("id AS row_id", "'s' AS source", "'t' AS target")
    one = lambda: row.withColumn("split", F.lit("train"))
    both = lambda: one().unionByName(row.withColumn("split", F.lit("test")))
    tables.materialize(spark, path, one, schemas.SPLIT_CORPUS, ["split"])
    for build in (both, one):  # a store without test rows is not served; the whole one is
        got = tables.materialize(spark, path, build, schemas.SPLIT_CORPUS, ["split"], parts)
        assert {r.split for r in got.collect()} == {"train", "test"}


def test_split_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "splits")
    df = spark.range(100).selectExpr("id AS row_id", "'s' AS source", "'t' AS target")
    stored = tables.materialize(
        spark, path, lambda: corpus.split_hash(df), schemas.SPLIT_CORPUS, ["split"]
    )
    plan = corpus.splits(stored)["test"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_predictions_store_replaces_single_models(spark, tmp_path):
    path = str(tmp_path / "predictions")

    def some(model, value):
        return spark.createDataFrame([(1, model, value), (2, model, value)], "row_id long, model string, prediction string")

    names = ["org/a-1.5B(finetuned)", "1.0", "b/c"]
    for model in names:
        tables.write_predictions(some(model, "old"), path)
    tables.write_predictions(some(names[0], "new"), path)
    got = {(r.model, r.row_id): r.prediction for r in tables.read_predictions(spark, path).collect()}
    assert got == {(m, i): "new" if m == names[0] else "old" for m in names for i in (1, 2)}


def test_pairs_need_adjacent_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"),
            (1, 4, "user", "q3"), (1, 5, "assistant", "a3"), (2, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.source, r.target) for r in pairs_from_turns(df).collect()}
    assert got == {("q1", "a1"), ("q3", "a3")}


def test_one_long_conversation_keeps_distinct_ids(spark):
    turns = spark.range(4000).selectExpr(
        "1L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role",
        "string(id) AS text",
    )
    pairs = pairs_from_turns(turns.unionByName(turns.withColumn("conv_id", F.lit(2).cast("long"))))
    assert pairs.count() == pairs.select("row_id").distinct().count() == 4000


def test_prepare_then_evaluate(spark, tmp_path):
    import numpy as np

    pairs = spark.range(50).selectExpr(
        "id AS row_id", "concat('s', id) AS source", "CASE WHEN id = 3 THEN 'NA' ELSE concat('t', id) END AS target"
    )
    parts = prepare(spark, lambda: pairs, str(tmp_path / "corpus"))
    assert {k: v.count() for k, v in parts.items()} == {"train": 39, "test": 10}

    def load():
        return lambda asked: np.array([p + "ok<|im_end|>" for p in asked])

    stored = evaluate(parts["test"], load, "org/m", TEMPLATES["chatml"], str(tmp_path / "p"))
    assert {r.prediction for r in stored.collect()} == {"ok"} and stored.count() == 10


def test_bad_lines_with_long_fields_and_counts(spark, tmp_path):
    long = '"' + "a ""quote"", and more\n".replace('"', '""') * 6000 + '"'
    (tmp_path / "f.csv").write_text("a,b\n1,2\n3,4,5\nx,y\n" + "9,8,7," + "z" * 120_000 + "\n")
    good, rejected = delimited.read_skipping_bad_lines(spark, str(tmp_path / "f.csv"), TWO)
    assert (good.count(), rejected.count()) == (2, 2)
    (tmp_path / "g.csv").write_text(f"a,b\n1,2\n{long},4,5\n{long},6\n")
    good, rejected = delimited.read_skipping_bad_lines(spark, str(tmp_path / "g.csv"), TWO)
    assert (good.count(), rejected.count()) == (2, 1)
