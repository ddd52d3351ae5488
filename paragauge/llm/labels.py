"""Labelled statistics: the bounded sample that quality models are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragauge.llm import statistics as S

#: At most so many labelled rows are fitted on; chosen by the hash of their id.
SAMPLE_ROWS = 20_000
FOLDS = 5


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Rows that no model learns from; a null id is not held out, and not learnt from either."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
           rows: int = SAMPLE_ROWS, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (0 or 1) of at most ``rows`` labelled ids outside the held-out fold.

    Of several labels of one id the larger counts; null ids, null labels and other values do not.
    Of several texts of one id the one with the largest features counts, merged per task first, so
    no more than ``rows`` rows reach the driver however often an id occurs.
    """
    chosen = (
        labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
        .where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("key")))
        .groupBy("key")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(rows)
    )
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    some = texts.join(F.broadcast(chosen), "key")
    counted = S.with_counts(some, ["key", "label"]).select("key", "label", *S.feature_columns())
    largest = F.max(F.struct("label", *S.FEATURES)).alias("one")
    table = counted.groupBy("key").agg(largest).select("one.*").toArrow()
    names = S.FEATURES
    found = np.column_stack([table[c].to_numpy() for c in names]) if table.num_rows else None
    if found is None:
        return np.empty((0, len(names))), np.empty(0, np.int64)
    truth = table["label"].to_numpy()
    order = np.lexsort([*found.T, truth])  # rows come in any order
    return found[order], truth[order]


def thresholds(values: np.ndarray, most: int = 32) -> np.ndarray:
    """Middles between neighbouring quantiles of one statistic."""
    points = np.unique(np.quantile(values, np.linspace(0, 1, most + 1), method="nearest"))
    return (points[1:] + points[:-1]) / 2


Condition = tuple[int, bool, float]
"""Number of the statistic, whether it must be above, and the threshold."""


def holds(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    found = np.ones(len(x), bool)
    for feature, above, limit in rule:
        found &= (x[:, feature] > limit) == above
    return found


def as_column(rule: list[Condition], columns: list[Column]) -> Column:
    found = F.lit(True)
    for feature, above, limit in rule:
        value = columns[feature]
        found = found & ((value > limit) if above else (value <= limit))
    return found


def wording(rule: list[Condition]) -> str:
    return " and ".join(
        f"{S.FEATURES[f]} {'>' if above else '<='} {limit:.6g}" for f, above, limit in rule
    )
