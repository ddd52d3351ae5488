"""Predictions of many models side by side: attach, check, reshape, select."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragauge.functions import text


def align(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """``(row_id, model, prediction, target)`` for every prediction that has a pair.

    Only text is shuffled; tokens are made after the join, where the scores need them: they would be
    ten times the volume of the reference. The merge hint keeps both sides partitioned by ``row_id`` at every size: scoring is the heavy
    part, so it must spread over all tasks even where Spark would broadcast small pairs, and the
    join stays one that adaptive execution splits if rows pile up on one id.
    """
    refs = pairs.select("row_id", "target")
    hyps = predictions.select("row_id", "model", "prediction")
    return hyps.join(refs.hint("merge"), "row_id")


def align_wide(wide: DataFrame, models: list[str] | None = None) -> DataFrame:
    """The same from a wide results table, where the reference is in the row already: no join, and
    the reference is tokenized once, before the row fans out."""
    models = models or model_columns(wide)
    refs = wide.withColumns(text.reference_tokens(F.col("target")))
    kept = ["row_id", "target", *text.reference_tokens(F.col("target"))]
    return refs.unpivot(kept, [quoted(m) for m in models], "model", "prediction")


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` replaces stored rows with the same ``(row_id, model)`` and adds the others."""
    kept = stored.join(new.select("row_id", "model"), ["row_id", "model"], "left_anti")
    return kept.unionByName(new)


def coverage(pairs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per model: expected, present, missing, duplicated and orphaned predictions.

    Copies are counted before anything is joined, so a heap of copies of one row shrinks to one
    row per task first.
    """
    refs = pairs.groupBy("row_id").agg(F.lit(True).alias("known"))
    per_row = predictions.groupBy("row_id", "model").agg(F.count("*").alias("copies"))
    per_model = (
        per_row.join(refs, "row_id", "left")
        .groupBy("model")
        .agg(
            F.count("known").alias("present"),
            F.count(F.when(F.col("known").isNull(), 1)).alias("orphans"),
            F.sum(F.col("copies") - 1).alias("duplicates"),
        )
    )
    expected = pairs.agg(F.count_distinct("row_id")).scalar()
    return per_model.withColumn("expected", expected).select(
        "model", "expected", "present",
        (F.col("expected") - F.col("present")).alias("missing"), "duplicates", "orphans",
    )


def require_coverage(pairs: DataFrame, predictions: DataFrame) -> None:
    """Raise unless ids of pairs are unique and every model has one prediction for every pair."""
    twice = pairs.groupBy("row_id").count().where("count > 1").count()
    if twice:
        raise ValueError(f"{twice} ids of pairs are not unique")
    faults = coverage(pairs, predictions).where("missing <> 0 OR duplicates <> 0 OR orphans <> 0")
    sums = [F.sum(c).alias(c) for c in ("missing", "duplicates", "orphans")]
    total = faults.agg(F.count("*").alias("models"), *sums).first()
    if total.models:
        shown = [str(row.asDict()) for row in faults.orderBy("model").limit(_SHOWN).collect()]
        rest = f"; and {total.models - len(shown)} more models" if total.models > len(shown) else ""
        raise ValueError(
            f"predictions do not line up with pairs: {total.asDict()}: " + "; ".join(shown) + rest
        )


_SHOWN = 20  # models named in the message; the totals cover all


def model_columns(wide: DataFrame, fixed: int = 3) -> list[str]:
    """Everything after ``row_id, source, target`` is a model."""
    return wide.columns[fixed:]


def pivot(pairs: DataFrame, predictions: DataFrame, models: list[str]) -> DataFrame:
    """One column per model. Only ``row_id`` is a grouping key; texts are joined on after.

    Two predictions of one model for one row are an error when the row is read.
    """
    found = predictions.groupBy("row_id").pivot("model", models).agg(
        F.first("prediction").alias("p"), F.count(F.lit(1)).alias("n")
    )
    message = F.concat(F.lit("more than one prediction for row "), F.col("row_id").cast("string"))
    wide = found.select(
        "row_id",
        *[
            F.when(F.col(quoted(f"{m}_n")) > 1, F.raise_error(message))
            .otherwise(F.col(quoted(f"{m}_p")))
            .alias(m)
            for m in models
        ],
    )
    return pairs.select("row_id", "source", "target").join(wide, "row_id", "left")


def unpivot(wide: DataFrame, models: list[str] | None = None) -> DataFrame:
    models = models or model_columns(wide)
    return wide.unpivot("row_id", [quoted(m) for m in models], "model", "prediction")


def quoted(name: str) -> str:
    """Model names hold dots, slashes and brackets."""
    return "`" + name.replace("`", "``") + "`"


def select_columns(wide: DataFrame, names: list[str]) -> DataFrame:
    return wide.select([quoted(n) for n in names])


def drop_columns_like(wide: DataFrame, part: str) -> DataFrame:
    return select_columns(wide, [c for c in wide.columns if part not in c])


def drop_columns(wide: DataFrame, names: list[str], errors: str = "raise") -> DataFrame:
    absent = [n for n in names if n not in wide.columns]
    if absent and errors == "raise":
        raise ValueError(f"no such columns: {absent}")
    return select_columns(wide, [c for c in wide.columns if c not in names])


def select_models(predictions: DataFrame, models: list[str]) -> DataFrame:
    return predictions.where(F.col("model").isin(models))


def drop_models_like(predictions: DataFrame, part: str) -> DataFrame:
    return predictions.where(~F.contains("model", F.lit(part)))


def model_basename(model="model"):
    return F.substring_index(model, "/", -1)


def row_slice(df: DataFrame, start: int, stop: int, key: str = "row_id") -> DataFrame:
    """Rows at positions ``start`` up to but without ``stop``; the range reaches the scan."""
    return df.where((F.col(key) >= start) & (F.col(key) < stop))


def head(df: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    """First rows by key: a top-n per task, not a full sort."""
    return df.orderBy(key).limit(n)
