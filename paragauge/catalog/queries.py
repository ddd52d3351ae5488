"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge import schemas
from paragauge.catalog import fixtures as fx
from paragauge.functions import text, treebank
from paragauge.operators import (
    bootstrap, corpus, generate, prompts, quantiles, results, scoring, sentences, translations,
)
from paragauge.plans import report, states
from paragauge.session import scratch_path
from paragauge.sources import bucketed, delimited, ranges, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.align(fx.pairs(spark, sf_dir), fx.predictions(spark, sf_dir))


def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.metrics_report(fx.pairs(spark, sf_dir), fx.predictions(spark, sf_dir))


# -- sources and sinks --------------------------------------------------------------------


@query
def tsv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "corpus-tsv")
    delimited.write_delimited(fx.pairs_dirty(spark, sf_dir), path)
    return delimited.read_delimited(spark, path, schemas.KEYED_CORPUS)


@query
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "results-csv")
    wide = fx.wide(spark, sf_dir)
    delimited.write_delimited(wide, path, sep=",", empty="pandas")
    return delimited.read_delimited(spark, path, wide.schema, sep=",")


def _quoted(text) -> F.Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


@query
def csv_skip_bad_lines(spark, sf_dir):
    """Every third line of the written file has one field too many, every fifth is short, and every
    seventh has a field of over 10,000 characters with quotes and separators. Good and rejected rows
    are returned, told apart by ``kind``."""
    path = scratch_path(spark, "results-lines")
    text = F.when(F.expr("row_id % 7 = 0"), F.repeat(F.concat("target", F.lit('", "')), 120)).otherwise(F.col("target"))
    line = (
        F.when(F.expr("row_id % 3 = 0"), F.concat_ws(",", "row_id", _quoted(text), F.lit("x"), F.lit("")))
        .when(F.expr("row_id % 5 = 0"), F.col("row_id").cast("string"))
        .otherwise(F.concat_ws(",", "row_id", _quoted(text), F.length("source")))
    )
    fx.pairs(spark, sf_dir).select(line.alias("value")).write.text(path)
    schema = T.StructType(
        [
            T.StructField("row_id", T.LongType()),
            T.StructField("target", T.StringType()),
            T.StructField("size", T.LongType()),
        ]
    )
    good, rejected = delimited.read_skipping_bad_lines(spark, path, schema, header=False)
    good = good.select(F.lit("good").alias("kind"), "*", F.lit(None).cast("string").alias("line"))
    rejected = rejected.select(F.lit("rejected").alias("kind"), F.regexp_replace("line", r"\n\z", "").alias("line"))
    return good.unionByName(rejected, allowMissingColumns=True)


#: Byte ranges of the one file in ``corpus_ranges``: small, so that fields with line ends are cut.
RANGE_BYTES = 16 << 10


@query
def corpus_ranges(spark, sf_dir):
    """One file, whose targets hold line ends, read and numbered by many tasks."""
    path = scratch_path(spark, "corpus-one-file")
    ordered = fx.pairs(spark, sf_dir).orderBy("row_id").select("source", "target")
    delimited.write_delimited(ordered.coalesce(1), path)
    return ranges.read_ranges(spark, path, schemas.CORPUS, row_id="row_id", split_bytes=RANGE_BYTES)


@query
def results_ranges(spark, sf_dir):
    """A wide results file, read in the same way."""
    path = scratch_path(spark, "results-one-file")
    wide = fx.wide(spark, sf_dir)
    delimited.write_delimited(wide.coalesce(1), path, sep=",")
    return ranges.read_ranges(spark, path, wide.schema, sep=",", split_bytes=RANGE_BYTES)


@query
def splits_scan(spark, sf_dir):
    labelled = corpus.split_hash(fx.pairs(spark, sf_dir))
    paths = {}
    for name, part in corpus.splits(labelled).items():
        paths[name] = scratch_path(spark, f"{name}-tsv")
        delimited.write_delimited(part, paths[name])
    return tables.read_splits(
        spark, paths, lambda p: delimited.read_delimited(spark, p, schemas.KEYED_CORPUS)
    )


@query
def materialize_once(spark, sf_dir):
    """The second build would give another split; the stored one is served."""
    path = scratch_path(spark, "splits")
    pairs = fx.pairs(spark, sf_dir)
    for seed in (17, 18):
        stored = tables.materialize(
            spark,
            path,
            lambda seed=seed: corpus.split_hash(pairs, seed=seed),
            schemas.SPLIT_CORPUS,
            partition_by=["split"],
            parts=["split=train", "split=test"],
        )
    return stored


@query
def predictions_store(spark, sf_dir):
    """Writing one model's predictions again leaves the other models' partitions alone."""
    path = scratch_path(spark, "predictions")
    tables.write_predictions(fx.predictions(spark, sf_dir), path)
    again = fx.pairs(spark, sf_dir).select(
        "row_id", F.lit("org/swap").alias("model"), F.col("source").alias("prediction")
    )
    tables.write_predictions(again, path)
    return tables.read_predictions(spark, path)


BUCKETS = 8


def _stores(spark, sf_dir) -> tuple[DataFrame, bucketed.Store]:
    """Pairs and predictions stored in the same buckets."""
    pairs = bucketed.pairs_store(scratch_path(spark, "bucketed-pairs"), BUCKETS)
    predictions = bucketed.predictions_store(scratch_path(spark, "bucketed-predictions"), BUCKETS)
    bucketed.write(fx.predictions(spark, sf_dir), predictions)
    return bucketed.write(fx.pairs(spark, sf_dir), pairs), predictions


@query
def bucketed_upsert(spark, sf_dir):
    """Some rows of one stored model are replaced, and some of a new one are added."""
    _, store = _stores(spark, sf_dir)
    new = fx.pairs(spark, sf_dir).where("row_id % 2 = 0").selectExpr(
        "row_id",
        "inline(array(named_struct('model', 'org/swap', 'prediction', source), "
        "named_struct('model', 'org/new', 'prediction', target)))",
    )
    return bucketed.upsert(spark, store, new)


@query
def bucketed_scores(spark, sf_dir):
    """Scores of stored predictions against stored pairs: buckets meet without an exchange."""
    pairs, store = _stores(spark, sf_dir)
    rows = results.align(pairs, bucketed.read(spark, store))
    return rounded(scoring.with_rouge_n(rows).select("row_id", "model", "rouge1", "rouge2"), "rouge1", "rouge2")


@query
def row_numbers(spark, sf_dir):
    """Numbers given to the rows of a file scan are 0..n-1, each once."""
    path = scratch_path(spark, "corpus-tsv")
    delimited.write_delimited(fx.pairs(spark, sf_dir).select("source", "target"), path)
    scan = delimited.read_delimited(spark, path, schemas.CORPUS)
    return delimited.with_row_id(scan).agg(
        F.count("*").alias("n"),
        F.min("row_id").alias("first"),
        F.max("row_id").alias("last"),
        F.count_distinct("row_id").alias("ids"),
    )


@query
def numbered_rows(spark, sf_dir):
    """The numbered rows themselves; the files hold the pairs by id, so numbers follow the ids."""
    path = scratch_path(spark, "ordered-tsv")
    ordered = fx.pairs(spark, sf_dir).orderBy("row_id").select("source", "target")
    delimited.write_delimited(ordered, path)
    return delimited.with_row_id(delimited.read_delimited(spark, path, schemas.CORPUS))


@query
def head_rows(spark, sf_dir):
    return results.head(fx.pairs(spark, sf_dir), 10)


# -- projections and filters --------------------------------------------------------------


@query
def nonempty_pairs(spark, sf_dir):
    return corpus.nonempty(fx.pairs_dirty(spark, sf_dir))


@query
def na_normalize(spark, sf_dir):
    return corpus.na_normalize(fx.pairs_dirty(spark, sf_dir))


@query
def select_models(spark, sf_dir):
    return results.select_columns(
        fx.wide(spark, sf_dir), ["row_id", "source", "target", "org/swap", "org/upper(finetuned)"]
    )


@query
def drop_models_like(spark, sf_dir):
    return results.drop_models_like(fx.predictions(spark, sf_dir), "bnb-4bit")


@query
def drop_columns_like(spark, sf_dir):
    return results.drop_columns_like(fx.wide(spark, sf_dir), "bnb-4bit")


@query
def drop_columns(spark, sf_dir):
    prompted = prompts.with_prompts(
        fx.pairs(spark, sf_dir), prompts.TEMPLATES["chatml"], model="org/copy"
    )
    return results.drop_columns(prompted, ["text", "prompt", "absent"], errors="ignore")


@query
def rename_column(spark, sf_dir):
    return fx.predictions(spark, sf_dir).withColumnRenamed("prediction", "hypothesis")


@query
def row_slice(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("doc_id", "lang", "text")
    return results.row_slice(docs, 100, 150, key="doc_id")


# -- joins --------------------------------------------------------------------------------


@query
def scored_pairs(spark, sf_dir):
    return aligned(spark, sf_dir).select("row_id", "model", "target", "prediction")


@query
def upsert_predictions(spark, sf_dir):
    stored = fx.predictions(spark, sf_dir)
    new = fx.pairs(spark, sf_dir).selectExpr(
        "row_id",
        "inline(array(named_struct('model', 'org/swap', 'prediction', source), "
        "named_struct('model', 'org/new', 'prediction', target)))",
    )
    return results.upsert(stored, new.where("row_id % 2 = 0"))


@query
def coverage_check(spark, sf_dir):
    """One model lacks rows, one has doubles, one has rows of no pair."""
    whole = fx.predictions(spark, sf_dir)
    faulty = whole.where("model <> 'org/copy' OR row_id % 7 <> 3").withColumn(
        "row_id", F.expr("CASE WHEN model = 'org/half-0.7' AND row_id % 5 = 1 THEN -row_id ELSE row_id END")
    )
    doubles = whole.where("model = 'org/swap' AND row_id % 3 = 0")
    return results.coverage(fx.pairs(spark, sf_dir), faulty.unionByName(doubles))


# -- metrics ------------------------------------------------------------------------------


@query
def split_counts(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("doc_id")
    return corpus.split_counts(corpus.split_hash(docs, key="doc_id"))


@query
def exact_match(spark, sf_dir):
    return rounded(scoring.exact_match(aligned(spark, sf_dir)), "accuracy")


@query
def exact_match_ids(spark, sf_dir):
    return scoring.exact_match_ids(aligned(spark, sf_dir))


@query
def ngram_overlap(spark, sf_dir):
    return scoring.ngram_overlap(aligned(spark, sf_dir))


@query
def bleu_corpus(spark, sf_dir):
    scores = scoring.bleu(aligned(spark, sf_dir))
    return rounded(scores.select("model", F.col("bleu_scores.bleu").alias("bleu")), "bleu")


def _bleu_fields(record: str) -> list:
    numbers = [F.round(f"{record}.{c}", 6).alias(c) for c in ("brevity_penalty", "length_ratio")]
    precisions = [F.round(F.col(f"{record}.precisions")[i], 6).alias(f"p{i + 1}") for i in range(4)]
    lengths = [F.col(f"{record}.{c}").alias(c) for c in ("translation_length", "reference_length")]
    return precisions + numbers + lengths


@query
def bleu_detail(spark, sf_dir):
    return scoring.bleu(aligned(spark, sf_dir)).select("model", *_bleu_fields("bleu_scores"))


@query
def rouge1(spark, sf_dir):
    rows = scoring.with_rouge_n(aligned(spark, sf_dir))
    return rounded(rows.select("row_id", "model", "rouge1"), "rouge1")


@query
def rouge2(spark, sf_dir):
    rows = scoring.with_rouge_n(aligned(spark, sf_dir))
    return rounded(rows.select("row_id", "model", "rouge2"), "rouge2")


@query
def rouge_l(spark, sf_dir):
    rows = scoring.with_rouge_l(aligned(spark, sf_dir))
    return rounded(rows.select("row_id", "model", "lcs", "rougeL"), "rougeL")


@query
def rouge_lsum(spark, sf_dir):
    rows = scoring.with_rouge_l(aligned(spark, sf_dir), summary=True)
    return rounded(rows.select("row_id", "model", "rougeL", "rougeLsum"), "rougeL", "rougeLsum")


@query
def rouge_mean(spark, sf_dir):
    rows = scoring.with_rouge_l(scoring.with_rouge_n(aligned(spark, sf_dir)))
    names = ["rouge1", "rouge2", "rougeL"]
    return rounded(scoring.mean_by_model(rows, *names), *names)


@query
def bootstrap_ci(spark, sf_dir):
    rows = scoring.with_rouge_n(aligned(spark, sf_dir))
    return rounded(bootstrap.bootstrap_ci(rows, "rouge1"), "mean", "low", "mid", "high")


def _meteor_rows(rows: DataFrame) -> DataFrame:
    return rounded(
        rows.select(
            "row_id", "model", F.col("matched").cast("long").alias("matched"),
            F.col("chunks").cast("long").alias("chunks"), "meteor",
        ),
        "meteor",
    )


@query
def meteor_pairs(spark, sf_dir):
    return _meteor_rows(scoring.with_meteor(aligned(spark, sf_dir), stem=False))


@query
def meteor_stem(spark, sf_dir):
    return _meteor_rows(scoring.with_meteor(aligned(spark, sf_dir)))


@query
def meteor_corpus(spark, sf_dir):
    rows = scoring.with_meteor(aligned(spark, sf_dir))
    return rounded(scoring.mean_by_model(rows, "meteor"), "meteor")


@query
def word_translations(spark, sf_dir):
    """Links between source and target words learned from the pairs."""
    table = translations.translations(fx.pairs(spark, sf_dir))
    return rounded(table.where("n >= 0.5").select("f", "e", "n", "p"), "n", "p")


@query
def learned_synonyms(spark, sf_dir):
    return rounded(translations.learned_synonyms(fx.pairs(spark, sf_dir)), "p")


@query
def meteor_synonym(spark, sf_dir):
    """Scores with the synonyms learned from the pairs."""
    synonyms = translations.learned_synonyms(fx.pairs(spark, sf_dir))
    return _meteor_rows(scoring.with_meteor(aligned(spark, sf_dir), synonyms=synonyms))


# -- reports ------------------------------------------------------------------------------


@query
def metrics_report(spark, sf_dir):
    return rounded(metrics_table(spark, sf_dir), *report.SCORES)


@query
def metrics_wide(spark, sf_dir):
    """The report from a wide results table."""
    return rounded(
        report.metrics_wide(fx.wide(spark, sf_dir)).select("model", *report.SCORES), *report.SCORES
    )


@query
def metrics_struct(spark, sf_dir):
    """The whole nested record, flattened."""
    return _flat(report.metrics(fx.pairs(spark, sf_dir), fx.predictions(spark, sf_dir)))


PARTS = 3


@query
def metrics_merged(spark, sf_dir):
    """The record from states of three parts, each scored alone; the second was first scored with
    other predictions and then replaced."""
    path = scratch_path(spark, "states")
    pairs, whole = fx.pairs(spark, sf_dir), fx.predictions(spark, sf_dir)
    wrong = pairs.select("row_id", F.lit("org/swap").alias("model"), F.col("source").alias("prediction"))
    for k, predicted in [(1, wrong), *((k, whole) for k in range(PARTS))]:
        here = F.expr(f"row_id % {PARTS} = {k}")
        states.write_state(states.state(pairs.where(here), predicted.where(here), f"part-{k}"), path)
    return _flat(states.report(states.read_states(spark, path)))


def _flat(full: DataFrame) -> DataFrame:
    record, scores = "all_metrics", ["rouge1", "rouge2", "rougeL", "rougeLsum"]
    return full.select(
        "model",
        *[F.round(f"{record}.{c}", 6).alias(c) for c in ("accuracy", "meteor")],
        F.round(f"{record}.bleu_scores.bleu", 6).alias("bleu"),
        *_bleu_fields(f"{record}.bleu_scores"),
        *[F.round(f"{record}.rouge_scores.{c}", 6).alias(c) for c in scores],
    )


@query
def metrics_describe(spark, sf_dir):
    return rounded(report.describe(metrics_table(spark, sf_dir)), *report.SCORES)


@query
def score_quantiles(spark, sf_dir):
    """Spread of the scores of single rows, per model and score."""
    rows = scoring.with_rouge_n(aligned(spark, sf_dir))
    found = quantiles.describe_by(rows, "model", ["rouge1", "rouge2"])
    return rounded(found, "mean", "std", "min", "max", "q25", "q50", "q75")


@query
def metrics_melt(spark, sf_dir):
    return rounded(report.melt(metrics_table(spark, sf_dir)), "value")


@query
def chart_frame(spark, sf_dir):
    return rounded(report.chart_frame(metrics_table(spark, sf_dir)), "value")


@query
def perf_report(spark, sf_dir):
    return rounded(report.perf_report(metrics_table(spark, sf_dir), fx.perf(spark)), "meteor")


@query
def stacked_bounds(spark, sf_dir):
    perf = report.perf_report(metrics_table(spark, sf_dir), fx.perf(spark))
    return rounded(report.stacked_bounds(perf), "meteor", "bottom", "top")


# -- splits and training order ------------------------------------------------------------


@query
def split_exact(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("doc_id", "text")
    return corpus.split_exact(docs, key="doc_id")


@query
def split_hash(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("doc_id", "text")
    return corpus.split_hash(docs, key="doc_id")


@query
def split_partition_check(spark, sf_dir):
    docs = fx.documents(spark, sf_dir).select("doc_id")
    return corpus.split_partition_check(
        docs, corpus.split_exact(docs, key="doc_id"), key="doc_id"
    )


ROWS_PER_SHARD = 128


def _ordered(spark, sf_dir) -> DataFrame:
    docs = fx.documents(spark, sf_dir).select("doc_id", "text")
    shards = corpus.shard_count(docs, ROWS_PER_SHARD)
    return corpus.training_order(docs, epochs=2, shards=shards, key="doc_id")


@query
def training_shuffle(spark, sf_dir):
    ranked = corpus.shard_rank(_ordered(spark, sf_dir), key="doc_id")
    return ranked.select("epoch", "shard", "position", "doc_id", "text")


@query
def training_shards(spark, sf_dir):
    """What a trainer reads back from the stored shards."""
    path = scratch_path(spark, "shards")
    corpus.write_training_shards(_ordered(spark, sf_dir), path)
    stored = "doc_id long, text string, shuffle_key string, epoch int, shard long"
    return spark.read.schema(stored).parquet(path)


# -- text functions -----------------------------------------------------------------------


@query
def extract_answer(spark, sf_dir):
    raw = fx.decoded(spark, sf_dir)
    return raw.select("row_id", "family", text.extract_answer(F.col("raw")).alias("answer"))


@query
def extract_answer_legacy(spark, sf_dir):
    raw = fx.decoded(spark, sf_dir)
    return raw.select("row_id", "family", text.extract_answer_legacy(F.col("raw")).alias("answer"))


@query
def prompt_render(spark, sf_dir):
    pairs = fx.pairs(spark, sf_dir)
    return pairs.select("row_id", prompts.instruction(F.col("source")).alias("prompt"))


@query
def message_list(spark, sf_dir):
    models = F.explode(F.array(F.lit("org/Qwen2-0.5B"), F.lit("org/Mistral-7B")))
    rows = fx.pairs(spark, sf_dir).select("row_id", "source", models.alias("model"))
    lists = prompts.messages(F.col("source"), F.col("model"))
    turns = rows.select("row_id", "model", F.posexplode(lists).alias("place", "m"))
    return turns.select("row_id", "model", F.col("place").cast("long").alias("place"), "m.*")


def _per_family(spark, sf_dir, column: str) -> DataFrame:
    pairs = fx.pairs(spark, sf_dir)
    parts = [
        prompts.with_prompts(pairs, template, model=family).select(
            "row_id", F.lit(family).alias("family"), column
        )
        for family, template in prompts.TEMPLATES.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def chat_render(spark, sf_dir):
    return _per_family(spark, sf_dir, "prompt")


@query
def training_text(spark, sf_dir):
    return _per_family(spark, sf_dir, "text")


@query
def conversation_render(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations")
    return prompts.render_conversations(turns, prompts.TEMPLATES["llama3"])


@query
def model_basename(spark, sf_dir):
    models = fx.predictions(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"))
    return models.select("model", results.model_basename().alias("model_name"), "n")


def _tokens(spark, sf_dir, tokenize) -> DataFrame:
    docs = fx.texts(spark, sf_dir).select("doc_id", tokenize(F.col("text")).alias("t"))
    return docs.select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens")
    )


@query
def tokenize_13a(spark, sf_dir):
    return _tokens(spark, sf_dir, text.tokenize_13a)


@query
def tokenize_rouge(spark, sf_dir):
    return _tokens(spark, sf_dir, text.tokenize_rouge)


@query
def tokenize_words(spark, sf_dir):
    return _tokens(spark, sf_dir, text.tokenize_words)


@query
def abbreviations(spark, sf_dir):
    """Words that the documents show to be abbreviations."""
    return rounded(sentences.abbreviations(fx.texts(spark, sf_dir)), "score")


@query
def treebank_words(spark, sf_dir):
    """Words of the targets by the Treebank conventions, with sentence ends by learned abbreviations."""
    known = sentences.abbreviations(fx.texts(spark, sf_dir))
    marked = sentences.with_sentences(fx.pairs(spark, sf_dir), known, "row_id", "target")
    words = marked.select("row_id", "marked", treebank.treebank_words(F.col("marked")).alias("t"))
    return words.select(
        "row_id", (F.size(F.split("marked", "\n"))).cast("long").alias("n_sentences"),
        F.size("t").cast("long").alias("n_words"), F.array_join("t", " ").alias("words"),
    )


@query
def ngrams(spark, sf_dir):
    """All n-grams of all documents, as one digest per document and order."""
    docs = fx.texts(spark, sf_dir).select(
        "doc_id", text.tokenize_rouge(F.col("text")).alias("t")
    )
    orders = range(1, 5)
    digests = [
        F.struct(
            F.lit(n).cast("long").alias("n"),
            F.size(f"ngrams_{n}").cast("long").alias("n_grams"),
            F.md5(F.array_join(f"ngrams_{n}", "|")).alias("digest"),
        )
        for n in orders
    ]
    return text.with_ngrams(docs, "t", orders).select("doc_id", F.inline(F.array(*digests)))


@query
def length_cap(spark, sf_dir):
    docs = fx.texts(spark, sf_dir)
    return corpus.length_cap(docs, cap=512).drop("text")


# -- reshape ------------------------------------------------------------------------------


@query
def unpivot_predictions(spark, sf_dir):
    return results.unpivot(fx.wide(spark, sf_dir))


@query
def pivot_predictions(spark, sf_dir):
    return fx.wide(spark, sf_dir)


# -- Python surfaces ----------------------------------------------------------------------


def _count_words(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(
        {"doc_id": batch["doc_id"], "n_words": batch["text"].str.split(" ").str.len()}
    )


@query
def map_batches(spark, sf_dir):
    docs = fx.texts(spark, sf_dir)
    return generate.map_batches(docs, _count_words, "doc_id bigint, n_words bigint")


def _echo_model():
    """Stand-in for a model: answers with the text it was asked to translate."""
    start, end = prompts.INSTRUCTION + "\n", "<|im_end|>"

    def predict(asked: np.ndarray) -> np.ndarray:
        sources = [p.split(start, 1)[1].rsplit(end, 1)[0] for p in asked]
        return np.array([p + s + end for p, s in zip(asked, sources)], dtype=object)

    return predict


@query
def batch_generate(spark, sf_dir):
    asked = prompts.with_prompts(
        fx.pairs(spark, sf_dir), prompts.TEMPLATES["chatml"], model="org/echo"
    )
    answers = generate.generate(asked, _echo_model, model="org/echo")
    return answers.select("row_id", "model", "prediction")


@query
def generate_resumed(spark, sf_dir):
    """Every third prompt has an answer when the run over all of them begins; only the rest is asked."""
    path = scratch_path(spark, "generated")
    asked = prompts.with_prompts(
        fx.pairs(spark, sf_dir), prompts.TEMPLATES["chatml"], model="org/echo"
    )
    generate.generate_missing(asked.where("row_id % 3 = 0"), _echo_model, "org/echo", path, parts=2)
    return generate.generate_missing(asked, _echo_model, "org/echo", path, parts=4)
