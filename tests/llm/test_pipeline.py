"""The pipeline against its stages in plain Python."""

import hashlib

import duckdb
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from paragauge.llm import bpe_replay, rule_ensemble
from tests.llm.test_jaccard_join import brute
from tests.llm.test_trie_dedup import lowered


@pytest.fixture(scope="module")
def kept(spark, sf_dir, tmp_path_factory):
    """The rows after every stage."""
    out, docs = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    out.append(docs.toPandas())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_columns(kept):
    assert all(list(k.columns) == list(kept[0].columns) for k in kept[:-1])
    assert list(kept[-1].columns) == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert all(len(k) for k in kept)


def test_quality_rejects_by_its_score(spark, sf_dir, kept):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = rule_ensemble.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = rule_ensemble.score(docs, model).toPandas()
    assert set(kept[1].doc_id) == set(scores.doc_id[scores.score >= 0.3])
    good = duckdb.sql(f"SELECT doc_id FROM '{sf_dir}/labels.parquet' WHERE quality = 1").df().doc_id
    assert good.isin(kept[1].doc_id).mean() > 0.98


def test_exact_dedup_keeps_the_largest_id(kept):
    best = {}
    for i, t in zip(kept[1].doc_id, kept[1].text):
        best[lowered(t)] = max(i, best.get(lowered(t), -1))
    assert sorted(kept[2].doc_id) == sorted(best.values())


def test_near_dedup_keeps_one_of_each(kept):
    rows = list(zip(kept[2].doc_id.tolist(), kept[2].text))
    assert sorted(kept[3].doc_id) == sorted(int(k) for k, _, c in brute(rows) if k == str(c))


def test_mix_reads_all_and_repeats_small_sources(kept):
    times = kept[4].doc_id.value_counts()
    assert set(times.index) == set(kept[3].doc_id) and set(times) <= {1, 2}
    words = lambda frame: frame.text.fillna("").str.split().str.len().groupby(frame.source).sum()
    passes = words(kept[4]) / words(kept[3])
    assert passes.min() == 1 and 1.1 < passes.max() < 1.4
    assert passes[words(kept[3]).idxmax()] == 1


def test_encoding(kept):
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=bpe_replay.vocabulary(bpe_replay.RANKS).ranks, special_tokens={},
    )
    text = dict(zip(kept[4].doc_id, kept[4].text))
    assert sorted(kept[5].doc_id) == sorted(kept[4].doc_id)
    for row in kept[5].itertuples():
        ids = library.encode_ordinary(text[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text[row.doc_id] or "").encode()).hexdigest()


def test_run_equals_the_stages(spark, sf_dir, kept):
    got = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert got == sorted(kept[-1].itertuples(index=False, name=None))


def test_empty_and_odd_documents(spark, sf_dir, tmp_path):
    table = pq.read_table(f"{sf_dir}/documents.parquet").schema
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y", "en", "s", 3), (2, "", "en", "s", 0)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    assert docs.columns == table.names
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for frame, n in ((docs, 2), (docs.where("false"), 0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, str(tmp_path))
        assert frame.count() == n
