"""Running a user's model, or any batch function, over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge.functions import text
from paragauge.schemas import PREDICTIONS
from paragauge.session import scratch_path


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Apply ``fn`` to batches of rows; its frames become the result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return map(fn, batches)

    return df.mapInPandas(run, schema)


def generate(
    prompts: DataFrame, make_predict_fn: Callable, model: str, batch_size: int = 32
) -> DataFrame:
    """``(row_id, model, decoded, prediction)`` from ``(row_id, prompt)``.

    ``make_predict_fn()`` loads the model once per Python worker and returns a function from an
    array of prompts to an array of decoded texts. The answer is extracted from each text.
    Write the result before scoring it: a lost executor then costs no second generation.
    """
    predict = predict_batch_udf(make_predict_fn, return_type=T.StringType(), batch_size=batch_size)
    decoded = prompts.select("row_id", F.lit(model).alias("model"), predict("prompt").alias("decoded"))
    return decoded.withColumn("prediction", text.extract_answer(F.col("decoded")))


PARTS = 16


def missing(prompts: DataFrame, path: str, model: str) -> DataFrame:
    """Prompts that have no prediction of ``model`` in the store at ``path`` yet."""
    stored = _stored_ids(prompts, path, model)
    return prompts if stored is None else prompts.join(stored, "row_id", "left_anti")


def _stored_ids(prompts: DataFrame, path: str, model: str) -> DataFrame | None:
    spark = prompts.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(PREDICTIONS).parquet(path).where(F.col("model") == model).select("row_id")


def generate_missing(
    prompts: DataFrame,
    make_predict_fn: Callable,
    model: str,
    path: str,
    parts: int = PARTS,
    batch_size: int = 32,
) -> DataFrame:
    """Predictions of ``model`` for all prompts, in the store at ``path``; only missing ones are asked for.

    The missing prompts are stored, in parts by the hash of their id. Each part is a job of its own that
    adds its predictions to the store when it ends, so a run that breaks off loses one part, and the
    next run skips every id that is stored. Prompts of a task are sorted by length, so that a batch of
    the model is padded little. Two runs for one model must not go on at the same time.
    """
    spark = prompts.sparkSession
    todo = scratch_path(spark, "prompts")
    part = F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int")
    missing(prompts, path, model).select("row_id", "prompt", part.alias("part")).write.partitionBy("part").parquet(todo)
    waiting = spark.read.schema("row_id long, prompt string, part int").parquet(todo)
    for k in range(parts):
        mine = waiting.where(F.col("part") == k).repartition("row_id").sortWithinPartitions(F.length("prompt"))
        answers = generate(mine, make_predict_fn, model, batch_size)
        answers.select(*PREDICTIONS.fieldNames()).write.mode("append").partitionBy("model").parquet(path)
    stored = spark.read.schema(PREDICTIONS).parquet(path).where(F.col("model") == model)
    return stored.select("row_id", "model", "prediction")
