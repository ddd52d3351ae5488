"""Sentence ends by abbreviations that are learned from the texts themselves, without labels.

A word is an abbreviation if it is followed by a period far more often than words are on the whole: a
log-likelihood ratio of the two explanations, weighted by its length, its inner periods and how
often it occurs without a final period (Kiss and Strunk, 2006). All of it is one count per word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragauge.session import scratch_path

# Fixed values of the published method: share of periods behind an abbreviation, and the least score.
BEHIND, LEAST = 0.99, 0.3
CLOSING = r"""["')\]}»”’]*"""


def _pieces(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _core(piece: Column) -> Column:
    """A piece in lower case without marks around it and without final periods."""
    bare = F.regexp_replace(F.lower(piece), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")
    return F.regexp_replace(bare, r"\.+$", "")


def _has_period(piece: Column) -> Column:
    return F.contains(piece, F.lit(".")) & F.rlike(piece, F.lit(rf"(?:^|[^.])\.{CLOSING}$"))


def abbreviations(texts: DataFrame, text: str = "text") -> DataFrame:
    """``(word, with_period, without, score)`` of the abbreviations in all texts.

    Pieces are counted as they stand, so that the patterns run once per different piece. The counts of
    words are a stored table: the totals and the words are read from it, not from the texts again.
    """
    pieces = texts.select(F.explode(_pieces(F.col(text))).alias("piece"))
    times = pieces.groupBy("piece").agg(F.count("*").alias("times"))
    ends = F.when(_has_period(F.col("piece")), F.col("times")).otherwise(F.lit(0))
    path = scratch_path(texts.sparkSession, "word-counts")
    times.select(_core(F.col("piece")).alias("word"), "times", ends.alias("ends")).groupBy("word").agg(
        F.sum("ends").alias("with_period"), F.sum(F.col("times") - F.col("ends")).alias("without")
    ).write.parquet(path)
    counted = texts.sparkSession.read.schema("word string, with_period long, without long").parquet(path)
    whole = counted.agg(F.sum("with_period").alias("periods"), F.sum(F.col("with_period") + F.col("without")).alias("n"))
    words = counted.where(F.rlike("word", F.lit(r"\p{L}")) & ~F.rlike("word", F.lit(r"\p{N}")) & (F.col("with_period") > 0))
    # One row of totals goes to every task.
    found = words.join(F.broadcast(whole)).where("periods < n")
    ab, rest, share = F.col("with_period"), F.col("without"), F.col("periods") / F.col("n")
    by_chance = ab * F.log(share) + rest * F.log(1 - share)
    by_rule = ab * F.log(F.lit(BEHIND)) + rest * F.log(F.lit(1 - BEHIND))
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = -2 * (by_chance - by_rule) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -rest)
    return found.withColumn("score", score).where(F.col("score") >= LEAST).select("word", "with_period", "without", "score")


def with_sentences(df: DataFrame, known: DataFrame, key: str, text: str, name: str = "marked") -> DataFrame:
    """Add ``name``: the text with a line feed behind each sentence and single blanks elsewhere.

    A piece with a final question or exclamation mark ends a sentence, and so does one with a final
    period, unless it is a ``known`` abbreviation or an initial, or the next piece begins in lower
    case. Only pieces with a final period travel to meet the abbreviations, so these may be any
    number. ``key`` must be unique.
    """
    pieces = df.select(key, F.posexplode(_pieces(F.col(text))).alias("at", "piece"))
    ended = pieces.where(_has_period(F.col("piece"))).select(key, "at", _core(F.col("piece")).alias("word"))
    kept = ended.join(known.select("word").distinct(), "word", "left_semi").groupBy(key).agg(F.collect_set("at").alias("_kept"))
    joined = df.join(kept, key, "left")
    own = _pieces(F.col(text))
    # Beside each piece the one after it: looked up by place, the text would be split again for every piece.
    both = F.zip_with(own, F.slice(own, 2, 1 << 30), lambda piece, after: F.struct(piece.alias("piece"), after.alias("after")))
    none = F.array().cast("array<int>")

    def marked(pair: Column, at: Column) -> Column:
        piece, after = pair.getField("piece"), pair.getField("after")
        strong = F.rlike(piece, F.lit(rf"[?!]{CLOSING}$"))
        initial = F.rlike(_core(piece), F.lit(r"^\p{L}$"))
        lower = F.coalesce(F.rlike(after, F.lit(r"^\p{Ll}")), F.lit(False))
        short = F.array_contains(F.coalesce("_kept", none), at)
        period = F.rlike(piece, F.lit(rf"\.{CLOSING}$")) & ~short & ~initial & ~lower
        return F.concat(piece, F.when(strong | period, F.lit("\n")).otherwise(F.lit(" ")))

    lines = F.trim(F.array_join(F.transform(both, marked), ""), F.lit(" \n"))
    return joined.withColumn(name, lines).drop("_kept")
