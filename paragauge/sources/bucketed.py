"""Tables stored in hash buckets of ``row_id``, so that joins on it need no exchange.

Pairs and predictions stored with the same number of buckets are aligned, scored and upserted bucket
by bucket. A store is a folder; its table name is derived from the path, so a later session that
gives the same ``Store`` finds the same files.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge import schemas
from paragauge.operators.results import quoted
from paragauge.sources.tables import is_complete

KEY = "row_id"
_MODE = "spark.sql.sources.partitionOverwriteMode"


@dataclass(frozen=True)
class Store:
    """Where a bucketed table lies and how it is laid out; these may not change once it is written.

    As many buckets as tasks should work on it: 128 MB to 1 GB each are a good size.
    """

    path: str
    schema: T.StructType
    buckets: int
    partition_by: str | None = None

    @property
    def name(self) -> str:
        return "bucketed_" + hashlib.md5(self.path.encode()).hexdigest()[:16]


def pairs_store(path: str, buckets: int) -> Store:
    return Store(path, schemas.KEYED_CORPUS, buckets)


def predictions_store(path: str, buckets: int) -> Store:
    return Store(path, schemas.PREDICTIONS, buckets, "model")


def write(df: DataFrame, store: Store) -> DataFrame:
    """Replace the whole table. Rows are dealt to their buckets first, so that there is one file for
    each bucket, or for each bucket and partition."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {store.name}")
    dealt = df.select(*map(quoted, store.schema.fieldNames())).repartition(store.buckets, KEY)
    writer = dealt.write.mode("overwrite").option("path", store.path).bucketBy(store.buckets, KEY).sortBy(KEY)
    if store.partition_by:
        writer = writer.partitionBy(store.partition_by)
    writer.saveAsTable(store.name)
    return df.sparkSession.table(store.name)


def read(spark: SparkSession, store: Store) -> DataFrame:
    """The stored table; registered first if this session does not know it yet."""
    if not spark.catalog.tableExists(store.name):
        if not is_complete(spark, store.path):
            raise FileNotFoundError(f"no finished table in {store.path}")
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in store.schema.fields)
        parts = f"PARTITIONED BY ({quoted(store.partition_by)})" if store.partition_by else ""
        spark.sql(
            f"CREATE TABLE {store.name} ({columns}) USING parquet {parts} CLUSTERED BY ({KEY}) "
            f"SORTED BY ({KEY}) INTO {store.buckets} BUCKETS LOCATION '{store.path}'"
        )
        if store.partition_by:
            spark.catalog.recoverPartitions(store.name)
    return spark.table(store.name)


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows that ``new`` does not replace, and the new ones.

    The join is on ``row_id`` alone, as the buckets are; the model is looked at row by row. Two new
    predictions for one row and model are refused when they are read.
    """
    one = new.groupBy(KEY, "model").agg(F.first("prediction").alias("prediction"), F.count("*").alias("n"))
    twice = F.raise_error(F.concat(F.lit("more than one new prediction for row "), F.col(KEY).cast("string")))
    checked = one.select(
        KEY, F.when(F.col("n") > 1, twice).otherwise(F.col("prediction")).cast("string").alias("prediction"), "model"
    )
    same = F.array_contains(F.array(stored["model"]), new["model"])
    kept = stored.join(new.hint("merge"), (stored[KEY] == new[KEY]) & same, "left_anti")
    return kept.select(KEY, "prediction", "model").unionByName(checked)


def upsert(spark: SparkSession, store: Store, new: DataFrame) -> DataFrame:
    """Put predictions for some rows of some models into the store.

    Only the partitions of these models are read and written; in them only the new rows travel, to
    their buckets. A partition is replaced when all of it is written, so a job that breaks off leaves
    the table as it was.
    """
    dealt = new.select(*store.schema.fieldNames()).repartition(store.buckets, KEY)
    models = [r.model for r in new.select("model").distinct().collect()]
    stored = read(spark, store).where(F.col("model").isin(models))
    merged = upserted(stored, dealt).select(*store.schema.fieldNames())
    usual = spark.conf.get(_MODE)
    spark.conf.set(_MODE, "dynamic")  # as an option it would not reach the insert
    try:
        merged.write.insertInto(store.name, overwrite=True)
    finally:
        spark.conf.set(_MODE, usual)
    spark.catalog.refreshTable(store.name)
    return spark.table(store.name)
