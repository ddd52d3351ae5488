"""Stored tables: written once and reused, or replaced model by model."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge.schemas import PREDICTIONS


def is_complete(spark: SparkSession, path: str, parts: Iterable[str] = ()) -> bool:
    """Whether a finished write is at ``path``; a broken-off one left no success mark. All of
    ``parts``, partition folders such as ``split=test``, must be there too."""
    needed = [spark._jvm.org.apache.hadoop.fs.Path(path, name) for name in ("_SUCCESS", *parts)]
    conf = spark._jsc.hadoopConfiguration()
    return all(p.getFileSystem(conf).exists(p) for p in needed)


def materialize(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    schema: T.StructType,
    partition_by: list[str] | None = None,
    parts: Iterable[str] = (),
) -> DataFrame:
    """Read the table at ``path``; build and write it first if it, or one of the partition folders
    ``parts``, is not there yet.

    Every use reads the stored rows, so a random split or a generated text stays as it was
    written, and a lost executor repeats a scan instead of the work behind it.
    """
    if not is_complete(spark, path, parts):
        build().write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_splits(spark: SparkSession, files: dict[str, str], read) -> DataFrame:
    """Named split files as one table with a ``split`` column."""
    parts = [read(path).withColumn("split", F.lit(name)) for name, path in files.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Replace the stored predictions of the models present, and leave all other models alone.

    Rebalancing keeps files large without sending a dominant model to one task.
    """
    (
        predictions.select(*PREDICTIONS.fieldNames())
        .hint("rebalance", "model")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model")
        .parquet(path)
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).parquet(path).select("row_id", "model", "prediction")
