"""Scoring many models and shaping the scores for tables and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paragauge.operators import scoring
from paragauge.operators.results import (
    align,
    align_wide,
    model_basename,
    require_coverage,
)

SCORES = ["accuracy", "meteor", "bleu_1", "rouge_l"]

# Chart labels by score column.
LABELS = {"meteor": "METEOR", "bleu_1": "BLEU-1", "rouge_l": "ROUGE-L"}


def score_rows(aligned: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """Every per-row score side by side. Scores nobody selects are not computed."""
    rows = scoring.with_bleu_parts(scoring.with_exact(aligned))
    rows = scoring.with_rouge_l(scoring.with_rouge_n(rows), summary=True)
    return scoring.with_meteor(rows, synonyms=synonyms)


def model_scores(aligned: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """One row per model: ``accuracy, meteor, bleu_1, rouge_l, all_metrics``.

    All models and metrics come from one pass over the aligned rows. ``bleu_1`` keeps the
    report's usual name but is corpus BLEU of order 4; unigram precision is
    ``all_metrics.bleu_scores.precisions[0]``.
    """
    totals = score_rows(aligned, synonyms).groupBy("model").agg(
        F.avg(F.col("exact").cast("double")).alias("accuracy"),
        F.avg("meteor").alias("meteor"),
        *scoring.bleu_totals(),
        *[F.avg(r).alias(r) for r in ("rouge1", "rouge2", "rougeL", "rougeLsum")],
    )
    return record(totals)


def record(totals: DataFrame) -> DataFrame:
    """The report's columns from means of scores and sums of BLEU counts."""
    full = totals.select(
        "*",
        scoring.bleu_struct().alias("bleu_scores"),
        F.struct("rouge1", "rouge2", "rougeL", "rougeLsum").alias("rouge_scores"),
    )
    return full.select(
        "model",
        "accuracy",
        "meteor",
        F.col("bleu_scores.bleu").alias("bleu_1"),
        F.col("rougeL").alias("rouge_l"),
        F.struct("accuracy", "meteor", "bleu_scores", "rouge_scores").alias("all_metrics"),
    )


def metrics(
    pairs: DataFrame,
    predictions: DataFrame,
    synonyms: DataFrame | None = None,
    check: bool = True,
) -> DataFrame:
    """``model_scores`` of long predictions. With ``check``, a first job over the ids raises
    unless each model has one prediction per pair; without, only present ones are scored."""
    if check:
        require_coverage(pairs, predictions)
    return model_scores(align(pairs, predictions), synonyms)


def metrics_wide(wide: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """``model_scores`` of a wide results table, one column per model after the pair."""
    return model_scores(align_wide(wide), synonyms)


def metrics_report(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    return metrics(pairs, predictions).select("model", *SCORES)


def describe(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max of numeric columns, one row per statistic."""
    columns = columns or SCORES
    names = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]

    def statistics(c: str):
        quarters = F.percentile(c, [0.25, 0.5, 0.75])
        return F.array(
            F.count(c).cast("double"), F.avg(c), F.stddev_samp(c), F.min(c),
            quarters[0], quarters[1], quarters[2], F.max(c),
        ).alias(c)

    arrays = table.agg(*[statistics(c) for c in columns])
    rows = F.arrays_zip(F.array(*map(F.lit, names)).alias("statistic"), *columns)
    return arrays.select(F.inline(rows)).toDF("statistic", *columns)


def melt(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(model, variable, value)``, one row per model and score."""
    return table.unpivot("model", columns or list(LABELS), "variable", "value")


def _label_text(value):
    return F.format_string("%.2f", value)


def chart_frame(table: DataFrame) -> DataFrame:
    """Bars of the score chart: melted scores with display name and number; empty bars out."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return (
        melt(table)
        .where("value <> 0")
        .withColumns({"label": labels[F.col("variable")], "value_text": _label_text(F.col("value"))})
    )


def perf_report(table: DataFrame, perf: DataFrame) -> DataFrame:
    """METEOR with train time, eval time and GPU by model; models without timings stay."""
    return table.select("model", "meteor").join(perf, "model", "left").withColumn(
        "model_name", model_basename()
    )


def stacked_bounds(perf_table: DataFrame) -> DataFrame:
    """Bars of the time chart: train time below, eval time from where it ends."""
    bars = perf_table.unpivot(["model", "meteor"], ["train_min", "eval_min"], "series", "value")
    order = F.when(F.col("series") == "train_min", 0).otherwise(1)
    below = W.partitionBy("model").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    bars = bars.withColumn("bottom", F.coalesce(F.sum("value").over(below), F.lit(0.0)))
    return bars.where("value <> 0").withColumns(
        {"top": F.col("bottom") + F.col("value"), "value_text": _label_text(F.col("value"))}
    )
