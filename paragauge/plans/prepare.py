"""From a corpus to prompts, and from prompts to stored predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paragauge.operators import corpus, prompts
from paragauge.operators.generate import generate
from paragauge.schemas import SPLIT_CORPUS
from paragauge.session import scratch_path
from paragauge.sources import tables


def prepare(
    spark: SparkSession, pairs: Callable[[], DataFrame], path: str, seed: int = 17
) -> dict[str, DataFrame]:
    """Clean and split once, then serve ``train`` and ``test`` from the stored table.

    The cleaned pairs are stored first, as the split reads their ids several times. A store without
    one of the two splits is built anew.
    """

    def build() -> DataFrame:
        clean = corpus.nonempty(corpus.na_normalize(pairs()))
        clean = tables.materialize(spark, scratch_path(spark, "clean"), lambda: clean, clean.schema)
        return corpus.split_exact(clean, seed=seed)

    parts = [f"split={name}" for name in (corpus.TRAIN, corpus.TEST)]
    stored = tables.materialize(spark, path, build, SPLIT_CORPUS, partition_by=["split"], parts=parts)
    return corpus.splits(stored)


def evaluate(
    test: DataFrame,
    make_predict_fn: Callable,
    model: str,
    template: prompts.ChatTemplate,
    predictions_path: str,
    batch_size: int = 32,
) -> DataFrame:
    """Prompt, generate and store one model's predictions; returns all stored ones."""
    asked = prompts.with_prompts(test, template, model)
    tables.write_predictions(
        generate(asked, make_predict_fn, model, batch_size), predictions_path
    )
    return tables.read_predictions(test.sparkSession, predictions_path)
