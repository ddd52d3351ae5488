"""URL filter: host and path rules first, then a cascade of Bloom filters over all hosts.

Level 0 holds the listed keys. Level 1 holds the keys of the corpus that are not listed but pass
level 0, level 2 the listed keys that pass level 1, and so on until nobody passes. As every key of
the corpus took part in building it, the cascade answers exactly for all of them, without a join.

The keys stay in Spark; per level only the words of its bit array reach the driver, and their size is
known before. An array beyond ``MAX_BYTES`` is not built; the listed keys are joined then.

Defined cases: a null url or one without ``://`` has empty host and path, which no rule fits and
which is never listed; repeated rows are judged alike; an empty table gives an empty result, and an
empty list blocks nothing; of fitting rules of equal length the earlier one decides; other columns
of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge.llm.words import mix
from paragauge.session import scratch_path

MAX_BYTES = 64 << 20
MOST_LEVELS = 64
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]
"""Host, beginning of the path, verdict."""


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def deciding(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


@dataclass
class Cascade:
    """Bit arrays by level; each level with its number of hashes."""

    levels: list[tuple[np.ndarray, int]] = field(default_factory=list)

    def passes(self, level: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        bits, hashes = self.levels[level]
        found = np.ones(len(one), bool)
        for i in range(hashes):
            at = place(one, two, level, i, len(bits) * 64)
            found &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    def reaches(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Keys that pass every level so far."""
        found = np.ones(len(one), bool)
        for level in range(len(self.levels)):
            found &= self.passes(level, one, two)
        return found

    def contains(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether each key is listed: the parity of the first level that it fails decides."""
        found = np.full(len(one), len(self.levels) % 2 == 1)
        open_ = np.arange(len(one))
        for level in range(len(self.levels)):
            passed = self.passes(level, one[open_], two[open_])
            found[open_[~passed]] = level % 2 == 1
            open_ = open_[passed]
        return found


def place(one: np.ndarray, two: np.ndarray, level: int, i: int, bits: int) -> np.ndarray:
    salt = mix(np.array([level * 64 + i], np.uint64))
    return mix(one ^ (two * (salt | np.uint64(1)))) % np.uint64(bits)


def _longs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy().view(np.uint64) for c in ("one", "two"))


def hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def build(keys: DataFrame, rate: float | None = None) -> Cascade | None:
    """The cascade over all rows of ``keys`` (key, listed); None if a level outgrows MAX_BYTES.

    ``rate`` is the share of unlisted keys that pass level 0; by default the one that makes the
    whole cascade smallest. The other levels let half pass.
    """
    spark = keys.sparkSession
    one, two = hashed(F.col("key"))
    store = scratch_path(spark, "cascade-keys")
    keys.select(one.alias("one"), two.alias("two"), "listed").distinct().write.parquet(store)
    stored = spark.read.schema("one long, two long, listed boolean").parquet(store)
    sizes = {r.listed: r["count"] for r in stored.groupBy("listed").count().collect()}
    listed, others = sizes.get(True, 0), sizes.get(False, 0)
    if rate is None:
        rate = min(0.5, max(1e-6, math.sqrt(0.5) * listed / max(others, 1)))
    cascade, count = Cascade(), listed
    while count:
        level = len(cascade.levels)
        if level == MOST_LEVELS:
            raise ValueError("a listed and an unlisted key have the same 128-bit hash")
        share = rate if level == 0 else 0.5
        hashes = max(1, round(-math.log2(share)))
        n_words = -(-math.ceil(count * hashes / math.log(2)) // 64)
        if n_words * 8 > MAX_BYTES:
            return None
        turn = stored.where(F.col("listed") == F.lit(level % 2 == 0))
        bits = _bits(turn, cascade, level, hashes, n_words)
        cascade = Cascade([*cascade.levels, (bits, hashes)])
        rest = stored.where(F.col("listed") != F.lit(level % 2 == 0))
        count = _reaching(rest, cascade).count()
    return cascade


def _reaching(keys: DataFrame, cascade: Cascade) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(cascade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.reaches(*_longs(batch))))

    return keys.select("one", "two").mapInArrow(run, "one long, two long")


def _bits(keys: DataFrame, cascade: Cascade, level: int, hashes: int, n_words: int) -> np.ndarray:
    """The bit array of the keys that pass the levels so far, merged word by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _longs(batch)
            at = np.concatenate([place(one, two, level, i, n_words * 64) for i in range(hashes)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((at >> np.uint64(6)).astype(np.int64)),
                    pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64)),
                ],
                names=["word", "mask"],
            )

    found = (
        _reaching(keys, cascade)
        .mapInArrow(run, "word long, mask long")
        .groupBy("word")
        .agg(F.bit_or("mask").alias("mask"))
        .toArrow()
    )
    bits = np.zeros(n_words, np.uint64)
    bits[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return bits


def with_listed(docs: DataFrame, key: Column, universe: DataFrame) -> DataFrame:
    """``docs`` with the column listed; ``universe`` (key, listed) has every key of ``docs``."""
    cascade = build(universe)
    if cascade is None:
        found = universe.where("listed").select(F.col("key").alias("__key"), F.lit(True).alias("listed"))
        joined = docs.join(found.distinct(), key == F.col("__key"), "left").drop("__key")
        return joined.withColumn("listed", F.coalesce("listed", F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(cascade)

    @F.arrow_udf(T.BooleanType())
    def listed(one: pa.Array, two: pa.Array) -> pa.Array:
        found = shared.value.contains(*(x.to_numpy().view(np.uint64) for x in (one, two)))
        return pa.array(found)

    return docs.withColumn("listed", listed(*hashed(key)))


def judge(pages: DataFrame, rules: list[Rule], sites: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and host, path, rule, verdict. ``sites`` (host) lists hosts to block where no rule fits; case
    does not matter there, and nulls, repeated and unknown hosts do no harm."""
    parts = pages.select(
        *[F.col(f"`{c}`") for c in keep], host(F.col("url")).alias("host"), path(F.col("url")).alias("path")
    )
    hosts = parts.select(F.col("host").alias("key")).distinct()
    named = sites.select(F.translate("host", UPPER, LOWER).alias("key"), F.lit(True).alias("listed"))
    universe = hosts.join(named.where("key <> ''").distinct(), "key", "left").select(
        "key", F.coalesce("listed", F.lit(False)).alias("listed")
    )
    rule, verdict = deciding(rules, F.col("host"), F.col("path"))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return with_listed(parts, F.col("host"), universe).select(
        *[F.col(f"`{c}`") for c in keep], "host", "path", rule.alias("rule"),
        F.coalesce(verdict, own).alias("verdict"),
    )
