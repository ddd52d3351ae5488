"""Connected components of a table of links, by alternating large and small stars.

Every step is a minimum per node (pre-aggregated) and a join, so a node with very many links is never
gathered. Each round is written to the shared scratch folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragauge.session import scratch_path


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); the label is the smallest node reachable."""
    spark = links.sparkSession
    store = scratch_path(spark, "components")

    def stored(frame: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        frame.write.parquet(f"{store}/{name}")
        frame = spark.read.schema("u long, v long").parquet(f"{store}/{name}")
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        return frame, tuple(frame.agg(F.count("*"), mark).first())

    clean = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, mark = stored(clean.where("u <> v").distinct(), "start")
    turn = 0
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _star(both, F.col("v") > F.col("u"))
        edges, now = stored(_star(edges, F.lit(True)).distinct(), f"round-{turn}")
        turn += 1
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _star(edges: DataFrame, moved) -> DataFrame:
    """Links (larger, smallest): neighbours that ``moved`` selects, and the node itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = edges.join(least, "u")
    neighbours = joined.where(moved & (F.col("v") != F.col("m"))).select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    own = least.where("u <> m").select("u", F.col("m").alias("v"))
    return neighbours.unionAll(own).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
