"""Reports that grow: mergeable score states per model and part.

A state holds what the report needs of some rows: their number and sums. Appended predictions are scored
alone, as a part of their own, and the report over everything is made from the stored states. Sums of
scores are decimals, so that they do not depend on how the rows are cut into parts. A part that is
written again replaces its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge.operators import scoring
from paragauge.operators.results import align, require_coverage
from paragauge.plans.report import record, score_rows

MEANS = ["meteor", "rouge1", "rouge2", "rougeL", "rougeLsum"]
COUNTS = ["hyp_len", "ref_len", *[f"{c}{n}" for n in range(1, scoring.MAX_ORDER + 1) for c in "mt"]]
_SUM = T.DecimalType(38, 15)

STATES = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("exact", T.LongType()),
        *[T.StructField(c, _SUM) for c in MEANS],
        *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("part", T.StringType()),
    ]
)


def state(pairs: DataFrame, predictions: DataFrame, part: str, synonyms: DataFrame | None = None, check: bool = True) -> DataFrame:
    """One row per model over the predictions of a part; ``pairs`` are those of the part.

    With ``check`` each model must have one prediction for each pair of the part.
    """
    if check:
        require_coverage(pairs, predictions)
    rows = score_rows(align(pairs, predictions), synonyms)
    # A score is at most 1, so 15 digits behind the point keep what a double holds.
    sums = [F.sum(F.col(c).cast("decimal(18,15)")).cast(_SUM).alias(c) for c in MEANS]
    return rows.groupBy("model").agg(
        F.count("*").alias("n"), F.sum(F.col("exact").cast("long")).alias("exact"), *sums, *scoring.bleu_totals()
    ).select(*STATES.fieldNames()[:-1], F.lit(part).alias("part"))


def write_state(states: DataFrame, path: str) -> None:
    """Store the states of a part; the models it holds are all that the part has from then on."""
    one = states.coalesce(1)  # a row per model
    one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATES).parquet(path)


def merge(states: DataFrame) -> DataFrame:
    """One state per model over all parts."""
    sums = [F.sum(c).cast(STATES[c].dataType).alias(c) for c in STATES.fieldNames() if c not in ("model", "part")]
    return states.groupBy("model").agg(*sums)


def report(states: DataFrame) -> DataFrame:
    """``report.model_scores`` from states: one row per model, whatever the number of rows behind."""
    merged = merge(states)
    means = {c: F.col(c).cast("double") / F.col("n") for c in MEANS}
    return record(merged.withColumns(means | {"accuracy": F.col("exact") / F.col("n")}))
