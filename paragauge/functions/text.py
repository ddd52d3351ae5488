"""Answer extraction, tokenizers and n-grams as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.ml.feature import NGram
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The strings read as missing by the CSV reader that produced the corpora.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Chat markers that end the prompt part of a decoded output.
ANSWER_MARKERS = ["assistant", "[/INST]"]
LEGACY_MARKERS = ["assistant"]
HEADER_END = "end_header_id|>\n\n"

# A word character as Unicode letters, numbers and underscore, spelled out so that the
# word boundary does not depend on the JDK's meaning of \b.
_W = r"[\p{L}\p{N}_]"
_BOUNDARY = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

# Every character that counts as white space in Unicode text.
UNICODE_SPACE = r"\x09-\x0d\x1c-\x20\x85\p{Z}"


def null_if_na(text: Column) -> Column:
    """Missing-value tokens become null; every other text is kept as it is."""
    return F.when(~text.isin(NA_TOKENS), text)


def _after_markers(text: Column, markers: list[str]) -> Column:
    # \G makes each match start where the one before ended, so a text without a further marker
    # is scanned once instead of once per start position; one without any only by byte search.
    either = "|".join(re.escape(m) for m in markers)
    marked = reduce(or_, [F.contains(text, F.lit(m)) for m in markers])
    return F.when(
        marked, F.regexp_replace(text, rf"(?s)\G.*?(?:{either}).+?{_BOUNDARY}", "")
    ).otherwise(text)


def _before_tag(text: Column, opening: str, closing: str, gap: int) -> Column:
    # Only the first opening mark can decide: if nothing closes it, nothing later does.
    start = F.instr(text, opening)
    closed = F.position(F.lit(closing), text, start + F.lit(gap)) > 0
    return F.when((start > 0) & closed, F.left(text, start - 1)).otherwise(text)


def extract_answer(text: Column) -> Column:
    """The answer inside a raw decoded output; plain text passes through."""
    answer = _after_markers(text, ANSWER_MARKERS)
    answer = _before_tag(answer, "<", ">", gap=2)
    return F.substring_index(answer, HEADER_END, -1)


def extract_answer_legacy(text: Column) -> Column:
    """Earlier variant: one marker, and only ``<|...|>`` tags end the answer."""
    return _before_tag(_after_markers(text, LEGACY_MARKERS), "<|", "|>", gap=2)


def tokenize_13a(text: Column) -> Column:
    """The mteval-13a tokenization used by corpus BLEU (case is kept)."""
    # Literal replacements, then punctuation rules, in their defined order.
    for old, new in (
        ("<skipped>", ""), ("-\n", ""), ("\n", " "),
        ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ):
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, replacement in (
        (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", " $1 "),
        (r"([^0-9])([\.,])", "$1 $2 "),
        (r"([\.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ):
        text = F.regexp_replace(text, pattern, replacement)
    return F.array_remove(F.split(text, f"[{UNICODE_SPACE}]+"), "")


def tokenize_rouge(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def rouge_lines(text: Column) -> Column:
    """ROUGE tokens joined by blanks, with line ends kept as sentence ends.

    Each line is split and joined: one pattern for gaps that leaves line ends alone took ten times as long.
    """
    lines = F.split(F.lower(text), "\n")
    return F.array_join(F.transform(lines, lambda line: F.array_join(F.split(line, "[^a-z0-9]+"), " ")), "\n")


def tokenize_words(text: Column) -> Column:
    """Lower-cased words, and every other visible character as a token of its own."""
    pattern = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_{UNICODE_SPACE}]"
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def reference_tokens(target: Column) -> dict[str, Column]:
    """What the metrics need from a reference; unused columns are pruned."""
    target = F.coalesce(target, F.lit(""))
    return {
        "target_13a": tokenize_13a(target),
        "target_rouge": tokenize_rouge(target),
        "target_lines": rouge_lines(target),
        "target_words": tokenize_words(target),
    }


def with_ngrams(df: DataFrame, tokens: str, orders: Iterable[int]) -> DataFrame:
    """Add ``ngrams_{n}``: all n-grams in text order, empty for fewer than ``n`` tokens."""
    for n in orders:
        df = NGram(n=n, inputCol=tokens, outputCol=f"ngrams_{n}").transform(df)
    return df
