"""Per-row scores and per-model metrics.

Input of everything here is an *aligned* table ``(row_id, model, target, prediction)`` as made
by ``results.align``. A row holds both sides of one pair, so its scores are computed where the
row is: the alignment join is the only exchange of text, and each metric then needs one
aggregation whose groups are models (partial sums per task, a handful of rows shuffled).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paragauge.functions import align, lcs, overlap, text

MAX_ORDER = overlap.MAX_ORDER

# METEOR's weight of precision against recall, and its chunk penalty.
METEOR_ALPHA = 0.9
METEOR_BETA = 3.0
METEOR_GAMMA = 0.5


def answers(aligned: DataFrame) -> DataFrame:
    """Add ``answer``: the extracted prediction; a null prediction scores as empty text."""
    return aligned.withColumn(
        "answer", F.coalesce(text.extract_answer(F.col("prediction")), F.lit(""))
    )


def _answered(aligned: DataFrame) -> DataFrame:
    """With ``answer`` and the reference tokens, as far as they are not there yet."""
    df = aligned if "answer" in aligned.columns else answers(aligned)
    tokens = text.reference_tokens(F.col("target"))
    return df.withColumns({c: tokens[c] for c in tokens if c not in df.columns})


# -- exact match --------------------------------------------------------------------------


def with_exact(aligned: DataFrame) -> DataFrame:
    return _answered(aligned).withColumn("exact", F.col("answer").eqNullSafe(F.col("target")))


def exact_match(aligned: DataFrame) -> DataFrame:
    return with_exact(aligned).groupBy("model").agg(
        F.count("*").alias("n"),
        F.sum(F.col("exact").cast("long")).alias("correct"),
        F.avg(F.col("exact").cast("double")).alias("accuracy"),
    )


def exact_match_ids(aligned: DataFrame) -> DataFrame:
    """Matching rows as rows; a list per model would not fit in one value at scale."""
    return with_exact(aligned).where("exact").select("model", "row_id")


# -- n-gram overlap -----------------------------------------------------------------------


def _with_overlaps(df: DataFrame, prefix: str, tokenize, reference: str) -> DataFrame:
    """Add token counts ``{prefix}_hyp``/``{prefix}_ref`` and ``{prefix}_matches`` by order."""
    df = df.withColumn("_hyp", tokenize(F.col("answer")))
    return df.withColumns(
        {
            f"{prefix}_hyp": F.size("_hyp").cast("long"),
            f"{prefix}_ref": F.size(reference).cast("long"),
            f"{prefix}_matches": overlap.clipped_matches(F.col("_hyp"), F.col(reference)),
        }
    ).drop("_hyp")


def _possible(tokens: Column, n: int) -> Column:
    return F.greatest(tokens - F.lit(n - 1), F.lit(0)).cast("long")


def ngram_overlap(aligned: DataFrame, orders: Iterable[int] = range(1, MAX_ORDER + 1)) -> DataFrame:
    """One row per pair and order: clipped matches and n-gram counts on 13a tokens."""
    df = with_bleu_parts(aligned)
    entry = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).cast("long").alias("n"),
                    F.get("b_matches", F.lit(n - 1)).alias("matches"),
                    _possible(F.col("b_hyp"), n).alias("hyp_ngrams"),
                    _possible(F.col("b_ref"), n).alias("ref_ngrams"),
                )
                for n in orders
            ]
        )
    )
    return df.select("row_id", "model", entry.alias("e")).select("row_id", "model", "e.*")


# -- BLEU ---------------------------------------------------------------------------------


def with_bleu_parts(aligned: DataFrame) -> DataFrame:
    return _with_overlaps(_answered(aligned), "b", text.tokenize_13a, "target_13a")


def bleu_totals() -> list[Column]:
    """Aggregates for a group of rows with BLEU parts."""
    totals = [F.sum("b_hyp").alias("hyp_len"), F.sum("b_ref").alias("ref_len")]
    for n in range(1, MAX_ORDER + 1):
        totals.append(F.sum(F.get("b_matches", F.lit(n - 1))).alias(f"m{n}"))
        totals.append(F.sum(_possible(F.col("b_hyp"), n)).alias(f"t{n}"))
    return totals


def bleu_struct() -> Column:
    """BLEU and its parts from ``bleu_totals``: no smoothing, one reference."""
    precisions = [
        F.when(F.col(f"t{n}") > 0, F.col(f"m{n}") / F.col(f"t{n}")).otherwise(0.0)
        for n in range(1, MAX_ORDER + 1)
    ]
    any_zero = F.least(*precisions) == 0
    log_mean = sum((F.log(p) for p in precisions), F.lit(0.0)) / F.lit(float(MAX_ORDER))
    ratio = F.when(F.col("ref_len") > 0, F.col("hyp_len") / F.col("ref_len"))
    penalty = (
        F.when(F.col("hyp_len") == 0, 0.0)
        .when(F.col("hyp_len") > F.col("ref_len"), 1.0)
        .otherwise(F.exp(1 - F.col("ref_len") / F.col("hyp_len")))
    )
    return F.struct(
        F.when(any_zero, 0.0).otherwise(F.exp(log_mean) * penalty).alias("bleu"),
        F.array(*precisions).alias("precisions"),
        penalty.alias("brevity_penalty"),
        ratio.alias("length_ratio"),
        F.col("hyp_len").alias("translation_length"),
        F.col("ref_len").alias("reference_length"),
    )


def bleu(aligned: DataFrame) -> DataFrame:
    """Corpus BLEU per model: counts are summed first, scores are never averaged."""
    return (
        with_bleu_parts(aligned)
        .groupBy("model")
        .agg(*bleu_totals())
        .select("model", bleu_struct().alias("bleu_scores"))
    )


# -- ROUGE --------------------------------------------------------------------------------


def f1(matches: Column, hyp: Column, ref: Column) -> Column:
    """Harmonic mean of matches/hyp and matches/ref, 0 where nothing matches."""
    precision = matches / F.greatest(hyp, F.lit(1))
    recall = matches / F.greatest(ref, F.lit(1))
    return F.when(matches > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def with_rouge_n(aligned: DataFrame, orders: Iterable[int] = (1, 2)) -> DataFrame:
    """Add ``rouge{n}`` per row."""
    df = _with_overlaps(_answered(aligned), "r", text.tokenize_rouge, "target_rouge")
    return df.withColumns(
        {
            f"rouge{n}": f1(
                F.get("r_matches", F.lit(n - 1)),
                _possible(F.col("r_hyp"), n),
                _possible(F.col("r_ref"), n),
            )
            for n in orders
        }
    )


def with_rouge_l(aligned: DataFrame, summary: bool = False) -> DataFrame:
    """Add ``rougeL``, and ``rougeLsum`` (sentence-wise on line ends) with ``summary``."""
    df = _answered(aligned).withColumn("_lines", text.rouge_lines(F.col("answer")))
    df = df.withColumn("_n", lcs.lcs_length("target_lines", "_lines"))
    sizes = F.col("_n.hyp"), F.col("_n.ref")
    scores = {"lcs": F.col("_n.lcs"), "rougeL": f1(F.col("_n.lcs"), *sizes)}
    if summary:
        df = df.withColumn("_hits", lcs.lcs_summary("target_lines", "_lines"))
        scores["rougeLsum"] = f1(F.col("_hits"), *sizes)
    return df.withColumns(scores).drop("_lines", "_n", "_hits")


# -- METEOR -------------------------------------------------------------------------------


def with_word_matches(aligned: DataFrame, stem: bool = True) -> DataFrame:
    """Add word arrays ``hyp_words``/``ref_words`` and ``matches`` of the exact (and stem) stage."""
    df = _answered(aligned).withColumns(
        {"hyp_words": text.tokenize_words(F.col("answer")), "ref_words": F.col("target_words")}
    )
    return df.withColumn(
        "matches", overlap.matched_words(F.col("hyp_words"), F.col("ref_words"), by_stem=stem)
    )


def meteor_score(matches: Column, chunks: Column, hyp: Column, ref: Column) -> Column:
    precision, recall = matches / hyp, matches / ref
    mean = precision * recall / (METEOR_ALPHA * precision + (1 - METEOR_ALPHA) * recall)
    penalty = METEOR_GAMMA * F.pow(chunks / matches, F.lit(METEOR_BETA))
    return F.when(matches > 0, (1 - penalty) * mean).otherwise(0.0)


def with_meteor(
    aligned: DataFrame, stem: bool = True, synonyms: DataFrame | None = None
) -> DataFrame:
    """Add ``matched``, ``chunks`` and ``meteor`` per row."""
    df = with_word_matches(aligned, stem=stem).withColumns(
        {
            "matched": F.size("matches"),
            "chunks": align.chunk_count(F.col("matches")),
            "hyp_size": F.size("hyp_words"),
            "ref_size": F.size("ref_words"),
        }
    )
    if synonyms is not None:
        from paragauge.operators.synonyms import with_synonym_matches

        df = with_synonym_matches(df, synonyms)
    return (
        df.withColumns({"hyp_words": F.col("hyp_size"), "ref_words": F.col("ref_size")})
        .drop("matches", "hyp_size", "ref_size")
        .withColumn(
            "meteor",
            meteor_score(F.col("matched"), F.col("chunks"), F.col("hyp_words"), F.col("ref_words")),
        )
    )


def mean_by_model(scored: DataFrame, *scores: str) -> DataFrame:
    return scored.groupBy("model").agg(*[F.avg(s).alias(s) for s in scores])
