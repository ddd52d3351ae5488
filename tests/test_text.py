import random
import re

import pytest
from pyspark.sql import functions as F

from paragauge.functions import porter, text

CASES = [
    ("x assistant\nHello world.<|im_end|>", "Hello world."),
    ('x assistant\n"Hello," he said.<|im_end|>', 'Hello," he said.'),
    ("x assistant\nMy assistant came in.<|im_end|>", "came in."),
    ("<s>[INST] q [/INST] The answer.</s>", "The answer."),
    ("<|start_header_id|>user<|end_header_id|>\n\nq<|eot_id|><|start_header_id|>assistant"
     "<|end_header_id|>\n\nThe answer.<|eot_id|>", "The answer."),
    ("plain text a < b > c tail", "plain text a "),
    ("assistant\n你好 world", "你好 world"),
    ("the assistant.", "the assistant."),
    ("assistants came", " came"),
    ("assistant\nété <b>x</b>", "été "),
    ("assistant …你好。ok", "你好。ok"),
    ("assistant [/INST] x", "INST] x"),
    ("assistantassistant x", " x"),
    ("a <b", "a <b"),
    ("a <> b > c", "a "),
    ("", ""),
    (None, None),
]


def column(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    rows = df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()
    return [r.out for r in rows]


def test_extract_answer_cases(spark):
    got = column(spark, [raw for raw, _ in CASES], text.extract_answer)
    assert got == [want for _, want in CASES]


def random_outputs(count):
    rng = random.Random(5)
    pieces = ["assistant", "[/INST]", "<", ">", "|", "<|", "|>", " ", "\n", ".", "word", "é", "好",
              "end_header_id|>\n\n", "_", "7"]
    return ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(count)]


@pytest.mark.parametrize("mode", ["current", "legacy"])
def test_extraction_equals_the_plain_patterns(spark, mode):
    """The linear forms do what deleting every match of the plain patterns does."""
    patterns, function = {
        "current": ([r".*?(assistant|\[/INST\]).+?\b", r"<.+?>.*", r".*?end_header_id\|>\n\n"],
                    text.extract_answer),
        "legacy": ([r".*?assistant.+?\b", r"<\|.*?\|>.*"], text.extract_answer_legacy),
    }[mode]
    outputs = random_outputs(1500)

    def plain(raw):
        for pattern in patterns:
            raw = re.sub(pattern, "", raw, flags=re.DOTALL)
        return raw

    assert column(spark, outputs, function) == [plain(raw) for raw in outputs]


def test_extraction_is_idempotent(spark):
    def twice(c):
        return text.extract_answer(text.extract_answer(c))

    values = [raw for raw, _ in CASES]
    assert column(spark, values, twice) == column(spark, values, text.extract_answer)


def test_long_text_without_marker_is_linear(spark):
    long = "word < " * 200_000
    assert column(spark, [long], text.extract_answer) == [long]


def test_tokenizers(spark):
    raw = "It's 3.5% off-\nline, 10-20 &amp; more... Été_1 你好!<skipped>"
    assert column(spark, [raw], text.tokenize_13a) == [
        ["It's", "3.5", "%", "offline", ",", "10", "-", "20", "&", "more", ".", ".", ".", "Été",
         "_", "1", "你好", "!"]
    ]
    assert column(spark, [raw], text.tokenize_rouge) == [
        ["it", "s", "3", "5", "off", "line", "10", "20", "amp", "more", "t", "1", "skipped"]
    ]
    assert column(spark, ["It's été, 你好!　x"], text.tokenize_words) == [
        ["it", "'", "s", "été", ",", "你好", "!", "x"]
    ]
    assert column(spark, [""], text.tokenize_13a) == [[]]


def test_ngrams_of_short_texts(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c", "d"][:i]) for i in range(5)], "i int, t array<string>")
    rows = text.with_ngrams(df, "t", [1, 3]).orderBy("i").collect()
    assert [r.ngrams_1 for r in rows] == [r.t for r in rows]
    assert [r.ngrams_3 for r in rows] == [[], [], [], ["a b c"], ["a b c", "b c d"]]


def test_na_tokens(spark):
    assert column(spark, ["NA", "None", "", "nano", " "], text.null_if_na) == [
        None, None, None, "nano", " ",
    ]


def test_porter_known_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed",
        "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
        "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
        "happy": "happi", "sky": "sky", "enjoy": "enjoy", "relational": "relat",
        "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "radically": "radic",
        "differently": "differ", "vietnamization": "vietnam", "predication": "predic",
        "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
        "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl",
        "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
        "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
        "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun",
        "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate",
        "cease": "ceas", "controll": "control", "roll": "roll", "dying": "die", "is": "is",
        "geologies": "geolog", "died": "die", "cried": "cri",
    }
    assert {w: porter.stem(w) for w in known} == known


def test_rouge_lines_are_those_of_one_pattern(spark):
    """Line by line gives what one pattern over the text gives, in a plan without that pattern."""
    texts = ["", None, "\n", " a\n\nB-c!\n", "é9\r\n\tX", "A.\n. b", "x\n", "İß\x0bq z", "--\n--"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lines = text.rouge_lines(F.col("t"))
    got = df.select(lines.alias("a"), F.regexp_replace(F.lower("t"), r"[^a-z0-9\n]+", " ").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert "[^a-z0-9\\n]+" not in str(lines) and "regexp_replace" not in str(lines)
