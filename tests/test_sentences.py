"""Sentence ends by learned abbreviations, and Treebank words."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paragauge.functions.treebank import treebank_words
from paragauge.operators import sentences

TEXTS = [
    "Dr. Smith met Mr. Jones on Main St. near the lake. They spoke. The lake is deep. He left.",
    "Mr. Brown saw Dr. Green. The house is old. Is it? Yes! It is. They left the house.",
    "Dr. Black and Mr. White own the house near the lake. No one knows. The end.",
    "",
    None,
]


def plain_scores(texts):
    counts = {}
    for text in texts:
        for piece in (text or "").split():
            bare = re.sub(r"^[^\w]+|[^\w.]+$", "", piece.lower())
            core = re.sub(r"\.+$", "", bare)
            period = bool(re.search(r"""(?:^|[^.])\.["')\]}»”’]*$""", piece))
            counts.setdefault(core, Counter())[period] += 1
    n, periods = sum(c.total() for c in counts.values()), sum(c[True] for c in counts.values())
    p = periods / n
    out = {}
    for word, c in counts.items():
        if c[True] and re.search(r"[^\W\d]", word) and not re.search(r"\d", word):
            chance = c[True] * math.log(p) + c[False] * math.log(1 - p)
            rule = c[True] * math.log(0.99) + c[False] * math.log(1 - 0.99)
            letters = len(word.replace(".", ""))
            out[word] = -2 * (chance - rule) * math.exp(-letters) * (word.count(".") + 1) * letters ** -c[False]
    return out


def test_scores_equal_the_published_formula(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS * 4], "text string")
    got = {r.word: r.score for r in sentences.abbreviations(df).collect()}
    want = {w: s for w, s in plain_scores(TEXTS * 4).items() if s >= 0.3}
    assert got.keys() == want.keys() >= {"dr", "mr"} and "lake" not in got and "house" not in got
    assert all(abs(got[w] - want[w]) < 1e-9 for w in want)
    assert sentences.abbreviations(df.where("false")).collect() == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("Dr. Smith came. He sat. ", ["Dr. Smith came.", "He sat."]),
        ('He said "Stop!" Then  he\nleft.', ['He said "Stop!"', "Then he left."]),
        ("J. Doe wrote it. it is short.", ["J. Doe wrote it. it is short."]),
        ("One... Two. Three?) Four", ["One...", "Two.", "Three?)", "Four"]),
        ("(It ended.) And on.", ["(It ended.)", "And on."]),
        ("", [""]),
    ],
)
def test_sentence_ends(spark, text, want):
    df = spark.createDataFrame([(1, text), (2, None)], "row_id long, target string")
    known = spark.createDataFrame([("dr",), ("dr",), ("st",)], "word string")
    got = {r.row_id: r.marked for r in sentences.with_sentences(df, known, "row_id", "target").collect()}
    assert got[1].split("\n") == want and got[2] is None


@pytest.mark.parametrize(
    "text,want",
    [
        ("They'll go, won't they?", "they 'll go , wo n't they ?"),
        ('"Quoted" text (in brackets) -- and more...', "`` quoted '' text ( in brackets ) -- and more ..."),
        ("It cost $3.50, i.e. 10:30 or 5%.", "it cost $ 3.50 , i.e . 10:30 or 5 % ."),
        ("I cannot cannot wanna go.\nGimme that: it's John's.", "i can not can not wan na go . gim me that : it 's john 's ."),
        ("Ends.\nTwice.", "ends . twice ."),
        ("", ""),
    ],
)
def test_words(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    words = df.select(treebank_words(F.col("t")).alias("w")).first().w
    if "i.e" in want:  # an inner period stays, whatever follows
        want = want.replace("i.e .", "i.e.")
    assert " ".join(words) == want


def test_counts_are_made_once_per_piece(spark, monkeypatch):
    """The patterns run behind the count of the pieces, and the texts are read once."""
    df = spark.createDataFrame([("He met Dr. Who. Dr. Who left.",)] * 40 + [(None,), ("",)], "text string")
    found = sentences.abbreviations(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "Generate" not in plan
    assert found.collect() == sentences.abbreviations(df.repartition(3)).collect()


def test_next_piece_is_not_looked_up_in_the_text(spark):
    """A text is split a bounded number of times, not again for each of its pieces."""
    import time

    known = spark.createDataFrame([], "word string")

    def seconds(n: int) -> float:
        df = spark.createDataFrame([(1, "Ab cd. " * n)], "k long, t string")
        start = time.perf_counter()
        (row,) = sentences.with_sentences(df, known, "k", "t").collect()
        assert row.marked == "\n".join(["Ab cd."] * n)
        return time.perf_counter() - start

    seconds(50)
    assert seconds(20_000) < 20
