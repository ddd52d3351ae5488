"""METEOR's synonym stage, for a table ``(word, alt)`` the user supplies or learned."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paragauge.functions import align, porter
from paragauge.session import scratch_path

#: Left-over words of a block, and of a block if that leaves cores without one.
BLOCK_WORDS, SMALL_BLOCK_WORDS = 1 << 19, 1 << 14
#: Rows of a block that are Python objects at once.
SLICE_ROWS = 256

_LEFT = "_key binary, hyp_left array<string>, ref_left array<string>, _place bigint"
_PICKED = "_key binary, _synonyms array<bigint>"


def pick_synonyms(edges: list[tuple[int, str]], ref: list[str]) -> list[int]:
    """Greedy from the end: each hypothesis word takes the last free reference word that is one
    of its alternatives. Each match is ``hyp << 32 | ref``."""
    free: dict[str, list[int]] = {}
    for place, word in enumerate(ref):
        free.setdefault(word, []).append(place)
    alternatives: dict[int, set[str]] = {}
    for place, alt in edges:
        alternatives.setdefault(place, set()).add(alt)
    found = []
    for place in sorted(alternatives, reverse=True):
        best = max((free[a][-1] for a in alternatives[place] if free.get(a)), default=None)
        if best is not None:
            free[ref[best]].pop()
            found.append(place << 32 | best)
    return found[::-1]


def _picked(rows: pa.Table, synonyms: pa.Table) -> pa.Table:
    """Synonym matches of a block's rows that have any, once per key and block."""
    alternatives: dict[str, set[str]] = defaultdict(set)
    for word, alt in zip(synonyms["word"].to_pylist(), synonyms["alt"].to_pylist()):
        alternatives[word].add(alt)
    found = {}
    for at in range(0, len(rows), SLICE_ROWS):
        part = rows.slice(at, SLICE_ROWS)
        for key, *sides in zip(*(part[c].to_pylist() for c in ("_key", "hyp_left", "ref_left"))):
            hyp, ref = (side.split("\n") for side in sides)
            there = set(ref)
            edges = [(i, a) for i, w in enumerate(hyp) if w in alternatives for a in alternatives[w] & there]
            if edges:
                found[key] = pick_synonyms(edges, ref)
    return pa.table(
        {"_key": pa.array(list(found), pa.binary()), "_synonyms": pa.array(list(found.values()), pa.list_(pa.int64()))}
    )


def _stored_left(matched: DataFrame) -> DataFrame:
    """``(_key, hyp_left, ref_left, _place)`` of rows with words left on both sides, stored, as they are read three times."""
    left = matched.select(
        "_key",
        porter.hyp_left_stems("hyp_words", "matches").alias("hyp_left"),
        porter.ref_left_stems("ref_words", "matches").alias("ref_left"),
        F.monotonically_increasing_id().alias("_place"),
    )
    # Nulls instead of a filter, for which matches and stems would be computed twice.
    both = (F.size("hyp_left") > 0) & (F.size("ref_left") > 0)
    path = scratch_path(matched.sparkSession, "left-words")
    left.select(*[F.when(both, F.col(c)).alias(c) for c in left.columns]).write.parquet(path)
    return matched.sparkSession.read.schema(_LEFT).parquet(path).where("_key IS NOT NULL")


def _n_blocks(spark: SparkSession, left: DataFrame) -> int:
    n_words = left.agg(F.sum((F.size("hyp_left") + F.size("ref_left")).cast("long"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    return max(-(-n_words // BLOCK_WORDS), min(cores, -(-n_words // SMALL_BLOCK_WORDS)), 1)


def _pick(matched: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``(_key, _synonyms)`` of rows with synonym matches: one plan at every size.

    Alternatives are not sent word by word to each row, as they are many times the text. Rows are dealt
    to blocks, by place, so that copies spread, and a block gets the alternatives of its different words
    once, beside the left-over words of its rows.
    """
    left = _stored_left(matched)
    n_blocks = _n_blocks(matched.sparkSession, left)
    left = left.withColumn("block", F.pmod(F.xxhash64("_place"), F.lit(n_blocks)).cast("int"))
    words = left.select("block", F.explode(F.array_distinct("hyp_left")).alias("word"))
    blocks = words.groupBy("word").agg(F.collect_set("block").alias("blocks"))
    told = blocks.join(synonyms, "word").select(F.explode("blocks").alias("block"), "word", "alt")
    # As one text, words take half the room of an array.
    left = left.withColumns({c: F.array_join(c, "\n") for c in ("hyp_left", "ref_left")})
    picked = left.drop("_place").groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_picked, _PICKED)
    return picked.dropDuplicates(["_key"])


def with_synonym_matches(matched: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Count synonym matches in ``matched`` and ``chunks`` of rows from ``scoring.with_word_matches``.

    The numbers of words are in ``hyp_size`` and ``ref_size``: arrays of words need not travel to meet the
    new matches, and the old ones only where words are left on both sides. The key is a digest of id, model
    and both texts, so that rows with the same id do not mix, and never null.
    """
    parts = [F.to_json(F.struct("row_id", "model")), F.array_join("hyp_words", "\n"), F.array_join("ref_words", "\n")]
    matched = matched.withColumn("_key", F.unhex(F.sha2(F.concat_ws("\n\n", *parts), 256)))
    picked = _pick(matched, synonyms.select("word", "alt").distinct())
    left = F.least("hyp_size", "ref_size") > F.size("matches")
    places = {
        "_hyp_at": _free("hyp_size", align.hyp_position),
        "_ref_at": _free("ref_size", align.ref_position),
    }
    more = align.at_positions(F.col("_synonyms"), F.col("_hyp_at"), F.col("_ref_at"))
    found = F.col("_synonyms").isNotNull()
    return (
        matched.withColumn("matches", F.when(left, F.col("matches")))
        .join(picked, "_key", "left")
        .withColumns(places)
        .withColumn("matches", F.concat("matches", more))
        .withColumns(
            {
                "matched": F.when(found, F.size("matches")).otherwise(F.col("matched")),
                "chunks": F.when(found, align.chunk_count(F.col("matches"))).otherwise(F.col("chunks")),
            }
        )
        .drop("_synonyms", "_hyp_at", "_ref_at", "_key")
    )


def _free(size: str, place) -> Column:
    """Positions no match takes, in the order of the left-over stems."""
    return align.left_positions(F.col(size), F.transform("matches", place))
