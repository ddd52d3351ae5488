"""Input tables of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paragauge.sources.dialogue import pairs_from_turns

MODELS = [
    "org/copy", "org/half-0.7", "org/source-bnb-4bit", "org/swap", "org/upper(finetuned)",
]
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_from_turns(table(spark, sf_dir, "conversations"))


def pairs_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = F.expr("row_id % 11")
    return pairs(spark, sf_dir).select(
        "row_id",
        F.when(fault != 0, F.col("source")).alias("source"),
        F.when(fault == 1, "").when(fault == 2, "   ").when(fault == 3, "NA")
        .when(fault == 4, "None").otherwise(F.col("target")).alias("target"),
    )


def _fan_out(df: DataFrame, per_model: dict[str, str]) -> DataFrame:
    """One output row per model from SQL expressions over the pair."""
    entries = ", ".join(
        f"named_struct('model', '{m}', 'prediction', {e})" for m, e in per_model.items()
    )
    return df.selectExpr("*", f"inline(array({entries}))")


PREDICTION_RULES = {
    "org/copy": "target",
    "org/half-0.7": "CASE WHEN row_id % 2 = 0 THEN target "
    "ELSE left(target, int(length(target) * 7 div 10)) END",
    "org/source-bnb-4bit": "source",
    "org/swap": "concat(substring(target, int(length(target) div 2) + 1), ' ', "
    "left(target, int(length(target) div 2)))",
    "org/upper(finetuned)": f"translate(target, '{LOWER}', '{UPPER}')",
}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fan_out(pairs(spark, sf_dir), PREDICTION_RULES).select("row_id", "model", "prediction")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paragauge.operators.results import pivot

    return pivot(pairs(spark, sf_dir), predictions(spark, sf_dir), MODELS)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model output: prompt and answer in each family's chat mark-up."""
    from paragauge.operators.prompts import TEMPLATES, with_prompts

    base = pairs(spark, sf_dir)
    out = None
    for family, template in TEMPLATES.items():
        gap = "" if template.generation else template.opening[None]
        part = with_prompts(base, template, model=family).select(
            "row_id",
            F.lit(family).alias("family"),
            F.concat("prompt", F.lit(gap), "target", F.lit(template.eos)).alias("raw"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def perf(spark: SparkSession) -> DataFrame:
    """Timings by model; the fifth model has none, and one train time is zero."""
    from paragauge.schemas import PERF

    return spark.createDataFrame(
        [
            ("org/copy", 11.5, 3.25, "card A"),
            ("org/half-0.7", 24.0, 7.5, "card A"),
            ("org/source-bnb-4bit", 0.0, 6.75, "card B"),
            ("org/swap", 31.25, 9.0, "card B"),
        ],
        PERF,
    )
