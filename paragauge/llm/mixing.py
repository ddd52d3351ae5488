"""Mixing sources to target weights by temperature.

The token share of each source is raised to an exponent and normalised. The exponent is bisected:
the largest one that reaches a target entropy, or the smallest one whose budget repeats no source
more often than a limit. Budgets are realised in blocks: rows are hashed to BLOCKS blocks of their
source; each pass over a source takes its blocks in a permutation of its own, and the last pass ends
at the block where the budget is met (to the nearest block).

There may be any number of sources. A weight depends on the source's tokens alone, so the driver gets
how many sources have each number of tokens: different numbers that add up to T tokens are fewer than
sqrt(2 T), some 4.5 million for 10**13 tokens. Weights and budgets per source are columns. Per source
at most BLOCKS rows meet in a window, whatever the size of the source. Rows themselves are joined to
their block's number of copies, by a broadcast if these are few (checked before).

Defined cases: null sources are one source of their own; null and empty texts have no tokens and go
with their block; a source without tokens has weight 0 and is taken once; an empty table gives an
empty result; repeated rows count and are taken separately; ties in a permutation go by block number;
columns of the input that are named like those of ``counted`` are replaced there, and kept by ``mix``.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragauge.session import scratch_path

BLOCKS = 256
#: Up to so many blocks of sources their copies are sent to every task.
TOLD_BLOCKS = 1 << 20
SEED = "mix"
#: Budget: as many tokens as there are.
AS_MANY = -1
STEPS = 60
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Plan:
    exponent: float
    weights: dict[str | None, float]
    budgets: dict[str | None, int]


@dataclass
class Solved:
    """A source with ``t`` of ``total`` tokens has the weight (t / total) ** exponent / norm, and that
    share of ``everything`` as its budget."""

    exponent: float
    total: int
    norm: float
    everything: float


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def entropy(shares: dict) -> float:
    """In bits."""
    return -sum(p * math.log2(p) for p in shares.values() if p > 0)


def bisect(good, low: float, high: float) -> float:
    """The end of the range of exponents from ``low`` for which ``good`` holds."""
    for _ in range(STEPS):
        middle = (low + high) / 2
        if good(middle):
            low = middle
        else:
            high = middle
    return low


def solve(counts: dict[int, int], entropy_share: float | None = None, repetitions: float | None = None,
          budget: int | None = None) -> Solved | None:
    """The exponent for sources of which ``counts[t]`` have t tokens; none if no source has any.

    ``entropy_share``: the wanted entropy as a share of the largest possible one; the exponent is
    the largest in [0, 1] that reaches it. ``repetitions``: no source may be read more often; the
    exponent is the smallest in [0, 1] that keeps to it, and with both given the larger of the two.
    ``budget``: tokens in all (AS_MANY: as many as there are); without it the least budget that reads every source at least once.
    """
    sizes = np.array(sorted(t for t in counts if t > 0), float)
    if not len(sizes):
        return None
    number = np.array([counts[int(t)] for t in sizes], float)
    total = sum(t * k for t, k in counts.items())
    if budget == AS_MANY:
        budget = total

    def shares(a: float) -> np.ndarray:
        raised = (sizes / total) ** a
        return raised / (raised * number).sum()

    def everything(part: np.ndarray) -> float:
        return budget if budget is not None else float((sizes / part).max())

    def most(a: float) -> float:
        part = shares(a)
        return float((everything(part) * part / sizes).max())

    def bits(a: float) -> float:
        part = shares(a)
        return float(-(number * part * np.log2(part)).sum())

    exponent = 1.0 if entropy_share is None and repetitions is None else 0.0
    if entropy_share is not None:
        target = entropy_share * math.log2(number.sum())
        exponent = bisect(lambda a: bits(a) >= target, 0.0, 1.0)
    if repetitions is not None:
        if most(1.0) > repetitions + 1e-9:
            raise ValueError(f"the budget needs {most(1.0):.3f} passes over every source")
        exponent = max(exponent, 1 - bisect(lambda a: most(1 - a) <= repetitions, 0.0, 1.0))
    norm = float((((sizes / total) ** exponent) * number).sum())
    return Solved(exponent, total, norm, everything(shares(exponent)))


def plan(tokens: dict, **target) -> Plan:
    """Weights and token budgets of sources given by name, by the rules of ``solve``."""
    tokens = {s: int(t) for s, t in tokens.items()}
    found = solve(Counter(tokens.values()), **target)
    if found is None:
        return Plan(1.0, dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 0))
    shares = {s: (t / found.total) ** found.exponent / found.norm if t else 0.0 for s, t in tokens.items()}
    return Plan(found.exponent, shares, {s: round(p * found.everything) for s, p in shares.items()})


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts).cast("binary"))


def block_of(key: Column) -> Column:
    digest = _digest(F.lit("block"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % BLOCKS).cast("int")


def blocks(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Tokens and rows of every (source, block); pre-aggregated before they are shuffled."""
    return (
        docs.select(
            F.col(f"`{source}`").alias("source"),
            block_of(F.col(f"`{key}`")).alias("block"),
            n_tokens(F.col(f"`{text}`")).alias("n"),
        )
        .groupBy("source", "block")
        .agg(F.sum("n").alias("tokens"))
    )


def source_tokens(per_block: DataFrame) -> DataFrame:
    """Tokens per source."""
    return per_block.groupBy("source").agg(F.sum("tokens").alias("t"))


def budgets(sources: DataFrame, found: Solved | None) -> DataFrame:
    """Whole passes over each source, and the tokens of its last, partial one."""
    t = F.col("t")
    if found is None:
        return sources.select("source", F.lit(1).cast("long").alias("passes"), F.lit(0).cast("long").alias("rest"))
    share = F.pow(t / F.lit(float(found.total)), F.lit(found.exponent)) / F.lit(found.norm)
    budget = F.round(share * F.lit(float(found.everything))).cast("long")
    return sources.withColumn("budget", budget).select(
        "source",
        F.when(t > 0, F.call_function("div", "budget", t)).otherwise(1).cast("long").alias("passes"),
        F.when(t > 0, F.col("budget") % t).otherwise(0).cast("long").alias("rest"),
    )


def copies(per_block: DataFrame, budget: DataFrame) -> DataFrame:
    """How often each block is read: whole passes, and one more for the last, partial pass."""
    joined = per_block.join(budget, per_block["source"].eqNullSafe(budget["source"])).drop(budget["source"])
    order = _digest(
        F.lit("pass"), F.coalesce("source", F.lit("")), F.col("passes").cast("string"),
        F.col("block").cast("string"),
    )
    before = Window.partitionBy("source").orderBy("turn", "block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    read = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    taken = (2 * read + F.col("tokens") <= 2 * F.col("rest")) & (F.col("rest") > 0)
    return joined.withColumn("turn", order).select(
        "source", "block", (F.col("passes") + taken.cast("long")).alias("copies")
    )


def _placed(docs: DataFrame, key: str, source: str, text: str, target: dict) -> DataFrame:
    """``docs`` with ``__block`` and ``__copies``."""
    spark = docs.sparkSession
    store = scratch_path(spark, "mix-blocks")
    blocks(docs, key, source, text).write.parquet(store)
    per_block = spark.read.schema("source string, block int, tokens long").parquet(store)
    store = scratch_path(spark, "mix-sources")
    source_tokens(per_block).write.parquet(store)
    sources = spark.read.schema("source string, t long").parquet(store)
    counts = {t: k for t, k in sources.groupBy("t").count().collect()}  # fewer than sqrt(2 T) rows
    numbers = copies(per_block, budgets(sources, solve(counts, **target))).select(
        F.col("source").alias("__source"), F.col("block").alias("__of"), F.col("copies").alias("__copies")
    )
    placed = docs.withColumn("__block", block_of(F.col(f"`{key}`")))
    same = placed[f"`{source}`"].eqNullSafe(F.col("__source")) & (F.col("__block") == F.col("__of"))
    small = sum(counts.values()) * BLOCKS <= TOLD_BLOCKS
    return placed.join(F.broadcast(numbers) if small else numbers, same).drop("__source", "__of")


def counted(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
            **target) -> DataFrame:
    """``docs`` with the columns block and copies (0: not in the mix)."""
    rows = _placed(docs, key, source, text, target)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("block", "copies")]
    return rows.select(*kept, F.col("__block").alias("block"), F.col("__copies").alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
        **target) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, each as often as it is read."""
    rows = _placed(docs, key, source, text, target)
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))
    passes = rows.where("__copies > 0").withColumn("__pass", repeated)
    return passes.select(*[F.col(f"`{c}`") for c in docs.columns])
