"""Preparing the parallel corpus: filters, splits, training order, length cap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paragauge.functions import hashing, text

TEST, TRAIN = "test", "train"
_DIGITS = 4  # hex digits per histogram level: at most 65,536 counts reach the driver


def nonempty(pairs: DataFrame) -> DataFrame:
    """Drop pairs with a null or empty side; white space counts as text."""
    return pairs.where("length(source) > 0 AND length(target) > 0")


def na_normalize(pairs: DataFrame) -> DataFrame:
    """Missing-value tokens become null on both sides."""
    return pairs.withColumns(
        {c: text.null_if_na(F.col(c)) for c in ("source", "target")}
    )


def split_hash(
    df: DataFrame, fraction: float = 0.2, seed: int = 17, key: str = "row_id"
) -> DataFrame:
    """Add ``split`` by hash threshold: about ``fraction`` of the rows, no pass over the data."""
    bucket = hashing.leading_int(hashing.random_key(seed, F.col(key))) % 10_000
    return df.withColumn(
        "split", F.when(bucket < int(fraction * 10_000), TEST).otherwise(TRAIN)
    )


def _cut(keys: DataFrame, fraction: float) -> str | None:
    """The key of the last of ``ceil(fraction * n)`` rows in key order, or None without rows.

    The key prefix is narrowed level by level; each level is one aggregation with map-side counts,
    so no task ever sorts the table. The first level also counts the rows.
    """
    if keys.where("id IS NULL").limit(1).count():
        raise ValueError("ids must not be null")
    prefix, rank, left = "", None, -1
    while len(prefix) < 32:
        inside = keys.where(F.startswith("k", F.lit(prefix))) if prefix else keys
        digits = F.substring("k", len(prefix) + 1, _DIGITS).alias("d")
        counts = sorted(map(tuple, inside.groupBy(digits).count().collect()))
        if rank is None:
            rank = math.ceil(fraction * sum(n for _, n in counts))
            if rank == 0:
                return None
        for d, left in counts:
            if rank <= left:
                break
            rank -= left
        prefix += d
        if left == 1:
            return keys.where(F.startswith("k", F.lit(prefix))).first().k
    if rank < left:
        raise ValueError("rows at the cut share one id; ids must be unique")
    return prefix


def split_exact(
    df: DataFrame, fraction: float = 0.2, seed: int = 17, key: str = "row_id"
) -> DataFrame:
    """Add ``split`` with exactly ``ceil(fraction * n)`` test rows, in random order of the ids.

    Finding the cut reads only the id column; labelling is then a comparison per row, without
    a sort, a window or a join. Give it a stored table: the ids are read once per level. Null ids,
    and ids that the cut would tear apart, are refused.
    """
    k = hashing.random_key(seed, F.col(key))
    last = _cut(df.select(k.alias("k"), F.col(key).alias("id")), fraction)
    if last is None:
        return df.withColumn("split", F.lit(TRAIN))
    return df.withColumn("split", F.when(k <= last, TEST).otherwise(TRAIN))


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"))


def splits(df: DataFrame) -> dict[str, DataFrame]:
    """Access by name; on a table partitioned by ``split`` each is a partition filter."""
    return {name: df.where(F.col("split") == name).drop("split") for name in (TRAIN, TEST)}


def split_partition_check(whole: DataFrame, parts: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: rows in both splits, rows lost, rows invented. All zero for a partition."""
    none, found = F.lit(None).cast("string"), parts.where(F.col("split").isin(TRAIN, TEST))
    sides = whole.select(key, none.alias("split")).unionByName(found.select(key, "split"))

    def rows(of) -> Column:
        return F.count(F.when(of, 1))

    per_id = sides.groupBy(key).agg(
        rows(F.col("split").isNull()).alias("n"),
        rows(F.col("split") == TRAIN).alias("train"),
        rows(F.col("split") == TEST).alias("test"),
    )
    gone = F.col("n") - F.col("train") - F.col("test")
    return per_id.agg(
        rows((F.col("train") > 0) & (F.col("test") > 0)).alias("in_both"),
        F.coalesce(F.sum(F.greatest(gone, F.lit(0))), F.lit(0)).alias("lost"),
        F.coalesce(F.sum(F.greatest(-gone, F.lit(0))), F.lit(0)).alias("invented"),
    )


def shard_count(df: DataFrame, rows_per_shard: int) -> int:
    """How many shards hold about ``rows_per_shard`` rows each; one pass that reads no column."""
    return max(1, math.ceil(df.count() / rows_per_shard))


def training_order(
    df: DataFrame, epochs: int, shards: int, seed: int = 3407, key: str = "row_id"
) -> DataFrame:
    """One row per epoch and input row with ``shard`` and a random ``shuffle_key``: reading the
    shards in any order, each by key, is a fresh shuffle per epoch."""
    spread = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    spread = spread.withColumn("shuffle_key", hashing.random_key(seed, F.col("epoch"), F.col(key)))
    return spread.withColumn("shard", hashing.leading_int(F.col("shuffle_key")) % shards)


def shard_rank(ordered: DataFrame, key: str = "row_id") -> DataFrame:
    """Add the position inside each epoch's shard; shards are sized by the caller."""
    window = W.partitionBy("epoch", "shard").orderBy("shuffle_key", key)
    return ordered.withColumn("position", F.row_number().over(window).cast("long"))


def write_training_shards(ordered: DataFrame, path: str) -> None:
    """Parquet folders ``epoch=/shard=`` with rows in shuffle order."""
    (
        ordered.repartition("epoch", "shard")
        .sortWithinPartitions("epoch", "shard", "shuffle_key")
        .write.partitionBy("epoch", "shard")
        .parquet(path)
    )


def length_cap(df: DataFrame, column: str | Column = "text", cap: int = 2048) -> DataFrame:
    """Add ``capped`` (at most ``cap`` word tokens, blank-joined), ``n_tokens``, ``truncated``."""
    tokens = text.tokenize_words(F.col(column) if isinstance(column, str) else column)
    return (
        df.withColumn("_tokens", tokens)
        .withColumns(
            {
                "n_tokens": F.size("_tokens").cast("long"),
                "truncated": F.size("_tokens") > cap,
                "capped": F.array_join(F.slice("_tokens", 1, cap), " "),
            }
        )
        .drop("_tokens")
    )
