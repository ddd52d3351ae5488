"""Generation that resumes, states that merge, synonyms that are learned."""

import random
from collections import Counter, defaultdict
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paragauge.operators import generate, scoring, translations
from paragauge.operators.results import align
from paragauge.plans import report, states


def counting_model(log):
    def make():
        def predict(asked):
            with open(log, "a") as f:
                f.writelines(f"{a}\n" for a in asked)
            if any(a == "stop" for a in asked):
                raise RuntimeError("stopped")
            return np.array([f"assistant\n{a}!" for a in asked], dtype=object)

        return predict

    return make


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, prompt string")


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "store")
    texts = [f"p{i}" * (i % 9 + 1) for i in range(60)]
    first = asked(spark, [*texts, "stop"])
    with pytest.raises(Exception, match="stopped"):
        generate.generate_missing(first, counting_model(log), "m", path, parts=5)
    done = set(log.read_text().split())
    stored = {r.row_id for r in spark.read.parquet(path).collect()}
    assert 0 < len(stored) < 60
    log.write_text("")
    out = generate.generate_missing(asked(spark, texts), counting_model(log), "m", path, parts=5)
    assert {r.row_id: r.prediction for r in out.collect()} == {i: f"{t}!" for i, t in enumerate(texts)}
    called = Counter(log.read_text().split())
    assert set(called) == {t for i, t in enumerate(texts) if i not in stored} and set(called.values()) == {1}
    assert {texts[i] for i in stored} <= done
    log.write_text("")  # nothing is missing any more; another model has all still to do
    generate.generate_missing(asked(spark, texts), counting_model(log), "m", path)
    assert log.read_text() == ""
    assert generate.missing(asked(spark, texts), path, "other").count() == 60


def test_batches_are_of_like_length(spark, tmp_path):
    sizes = []

    def make():
        return lambda batch: np.array([f"{len(batch[0])} {max(map(len, batch)) - min(map(len, batch))}" for _ in batch], dtype=object)

    texts = ["x" * random.Random(i).randint(1, 400) for i in range(300)]
    out = generate.generate_missing(asked(spark, texts), make, "m", str(tmp_path / "s"), parts=1, batch_size=10)
    sizes = [int(r.prediction.split()[1]) for r in out.collect()]
    assert sum(sizes) / len(sizes) < 120  # unsorted batches of ten span some 330


def scored(spark, n):
    rng = random.Random(n)
    word = lambda: rng.choice(["tree", "trees", "house", "houses", "a", "b", "c", "\n"])
    text = lambda k: " ".join(word() for _ in range(k))
    pairs = spark.createDataFrame([(i, "s", text(9)) for i in range(n)], "row_id long, source string, target string")
    guesses = [(i, m, text(8) if i % 3 else None) for i in range(n) for m in ("m/1", "m.2")]
    return pairs, spark.createDataFrame(guesses, "row_id long, model string, prediction string")


def flat(df):
    return {r.model: r.asDict(recursive=True) for r in df.collect()}


def test_states_of_parts_make_the_report(spark, tmp_path):
    pairs, predictions = scored(spark, 40)
    path = str(tmp_path / "states")
    wrong = predictions.withColumn("prediction", F.lit("house"))
    for part, of in (("x", wrong), ("y", predictions), ("x", predictions)):
        here = F.col("row_id") < 13 if part == "x" else F.col("row_id") >= 13
        states.write_state(states.state(pairs.where(here), of.where(here), part), path)
    got, want = flat(states.report(states.read_states(spark, path))), flat(report.metrics(pairs, predictions))
    assert got.keys() == want.keys() == {"m/1", "m.2"}

    def same(x, y):
        if isinstance(x, dict):
            return all(same(x[k], y[k]) for k in x) and x.keys() == y.keys()
        if isinstance(x, list):
            return len(x) == len(y) and all(map(same, x, y))
        return x == y or abs(x - y) < 1e-12

    assert same(got, want)
    whole = states.state(pairs, predictions, "all").drop("part")
    merged = states.merge(states.read_states(spark, path))
    assert flat(whole.select(merged.columns)) == flat(merged)  # exact, whatever the parts


def test_a_part_must_be_covered(spark):
    pairs, predictions = scored(spark, 6)
    with pytest.raises(ValueError):
        states.state(pairs, predictions.where("row_id <> 3"), "x")


def plain_em(rows, rounds):
    together = [(Counter(s.split()), Counter(t.split())) for s, t in rows]
    p = defaultdict(lambda: 1.0)
    for _ in range(rounds):
        n = defaultdict(float)
        for source, target in together:
            for e, ce in target.items():
                total = sum(cf * p[f, e] for f, cf in source.items())
                for f, cf in source.items():
                    n[f, e] += ce * cf * p[f, e] / total
        sums = defaultdict(float)
        for (f, _), v in n.items():
            sums[f] += v
        p = {k: v / sums[k[0]] for k, v in n.items()}
    return n, p


SEGMENTS = [
    ("das haus", "the house"), ("das haus", "the home"), ("ein haus", "a house"), ("das buch", "the book"),
    ("ein buch buch", "a book book"), ("ein heim", "a home"), ("das", "the"), ("", "x"), ("y", ""),
]


def test_translations_equal_plain_em(spark):
    pairs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(SEGMENTS)], "row_id long, source string, target string")
    n, p = plain_em(SEGMENTS, 4)
    got = {(r.f, r.e): (r.n, r.p) for r in translations.translations(pairs, rounds=4).collect()}
    assert got.keys() == n.keys()
    assert all(abs(got[k][0] - n[k]) < 1e-9 and abs(got[k][1] - p[k]) < 1e-9 for k in n)


def many_words(n, width):
    word = lambda side, i, k: f"{side}{(i * 7 + k * k) % (3 * width)}"
    return [(" ".join(word("s", i, k) for k in range(width)), " ".join(word("t", i, k) for k in range(width))) for i in range(n)]


def test_translations_store_no_word_pairs(spark):
    """What is stored grows with the text, not with the word pairs, which are a hundred times as many."""
    segments = many_words(60, 120)
    rows = [(i, s, t) for i, (s, t) in enumerate(segments)]
    pairs = spark.createDataFrame(rows, "row_id long, source string, target string")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("*"))
    got = {(r.f, r.e): r.n for r in translations.translations(pairs, rounds=2).collect()}
    n, _ = plain_em(segments, 2)
    assert got.keys() == n.keys() and all(abs(got[k] - n[k]) < 1e-9 for k in n)
    new = [f for d in set(folder.glob("*")) - before for f in d.rglob("*.parquet")]
    assert new and sum(f.stat().st_size for f in new) < 2 * sum(len(s) + len(t) for s, t in segments)


def test_translations_do_not_depend_on_blocks(spark, monkeypatch):
    monkeypatch.setattr(translations, "SMALL_BLOCK_PAIRS", 4)
    rows = [(i % 7, s, t) for i, (s, t) in enumerate(SEGMENTS)] + [(None, "das", "the")]
    pairs = spark.createDataFrame(rows, "row_id long, source string, target string")
    merged = [[" ".join(r[k] for r in rows if r[0] == i) for k in (1, 2)] for i in range(7)]
    n, p = plain_em(merged, 3)
    got = {(r.f, r.e): (r.n, r.p) for r in translations.translations(pairs, rounds=3).collect()}
    assert got.keys() == n.keys()
    assert all(abs(got[k][0] - n[k]) < 1e-9 and abs(got[k][1] - p[k]) < 1e-9 for k in n)


def test_units_of_any_size_give_the_same_links(monkeypatch):
    sides = [(sorted(Counter(s.split()).items()), sorted(Counter(t.split()).items())) for s, t in many_words(30, 8)]
    numbers = {f: i for i, f in enumerate(sorted({f for source, _ in sides for f, _ in source}))}
    table = pa.table(
        {
            "ids": pa.array([[numbers[f] for f, _ in source] for source, _ in sides], pa.list_(pa.int32())),
            "cfs": pa.array([[c for _, c in source] for source, _ in sides], pa.list_(pa.int32())),
            "es": pa.array([[e for e, _ in target] for _, target in sides], pa.list_(pa.string())),
            "ces": pa.array([[c for _, c in target] for _, target in sides], pa.list_(pa.int32())),
        }
    )
    totals = SimpleNamespace(value=[np.linspace(1, 2, len(numbers)), np.linspace(2, 1, len(numbers))])

    def links():
        batches = translations._links(totals, len(numbers))(iter(table.to_batches()))
        rows = pa.Table.from_batches(batches).to_pylist()
        sums = translations._sums(totals, len(numbers))(table)["sums"].to_pylist()
        return {(r["id"], r["e"]): (r["n"], r["p"], r["back"]) for r in rows}, np.frombuffer(b"".join(sums))

    whole, sums = links()
    for size in (1, 20, 100):
        monkeypatch.setattr(translations, "UNIT_PAIRS", size)
        parts, part_sums = links()
        assert parts.keys() == whole.keys() and np.allclose(part_sums, sums, atol=1e-12)
        assert all(np.allclose(parts[k], whole[k], atol=1e-12) for k in whole)


def test_words_of_one_source_become_synonyms(spark):
    pairs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(SEGMENTS * 3)], "row_id long, source string, target string")
    found = {(r.word, r.alt): r.p for r in translations.learned_synonyms(pairs, rounds=8).collect()}
    assert found["house", "home"] > 0.1 and found["home", "house"] > 0.1
    assert all(w != a for w, a in found) and found.get(("house", "book"), 0) < 0.05
    rows = spark.createDataFrame([(1, "m", "the home")], "row_id long, model string, prediction string")
    refs = spark.createDataFrame([(1, "the house")], "row_id long, target string")
    table = spark.createDataFrame(list(found), "word string, alt string")
    scores = scoring.with_meteor(align(refs, rows), synonyms=table.where("word = 'home' AND alt = 'house'"))
    # Stems are looked up, and both words are their own stem but for the last letter.
    assert scores.first().matched in (1, 2)


def test_learned_synonyms_group_pivots_only(spark):
    """Shares of source words come with the links: the whole table is neither grouped nor joined for them."""
    pairs = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(SEGMENTS)], "row_id long, source string, target string")
    learned = translations.learned_synonyms(pairs, rounds=3)
    plan = learned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and plan.count("Join ") == 1
    plain = translations.pivoted(translations.translations(pairs, rounds=3)).where(F.col("p") >= translations.LEAST)
    got, want = ({(r.word, r.alt): r.p for r in df.collect()} for df in (learned, plain))
    assert got and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_synonym_plan_carries_no_arrays(spark):
    """Neither a join nor a group has an array of words among its keys or between its sides."""
    pairs, predictions = scored(spark, 5)
    table = spark.createDataFrame([("tree", "hous")], "word string, alt string")
    out = scoring.with_meteor(align(pairs, predictions), synonyms=table)
    text = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in text.splitlines() if "Join " in line or "Aggregate " in line]
    assert joins and not any("hyp_left" in line.split("],")[0] or "ref_left" in line for line in joins)
