"""Words by the Penn Treebank conventions, as column expressions over texts with marked sentences.

Sentences are separated by line feeds (see ``operators.sentences``), because only the last period of a
sentence is a word of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published conventions, in their order. Blanks are doubled before the last group, so
# that neighbouring words do not share one.
_PUNCTUATION = [
    (r'(?m)^"', "``"),
    (r"(``)", " $1 "),
    (r"""([ (\[{<])("|'{2})""", "$1 `` "),
    (r"""(?m)([^.])(\.)([\])}>"'»”’ ]*)$""", "$1 $2 $3 "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"(?m)([:,])$", " $1 "),
    (r"(\.{2,})", " $1 "),
    (r"([;@#$%&?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>«»“”„‘’])", " $1 "),
    (r"(--)", " $1 "),
    (r"('')", " $1 "),
    (r'(")', " '' "),
]
_CONTRACTIONS = [
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r"(?i) (can)(not) ", " $1 $2 "),
    (r"(?i) (d)('ye) ", " $1 $2 "),
    (r"(?i) (gim)(me) ", " $1 $2 "),
    (r"(?i) (gon)(na) ", " $1 $2 "),
    (r"(?i) (got)(ta) ", " $1 $2 "),
    (r"(?i) (lem)(me) ", " $1 $2 "),
    (r"(?i) (more)('n) ", " $1 $2 "),
    (r"(?i) (wan)(na) ", " $1 $2 "),
    (r"(?i) ('t)(is) ", " $1 $2 "),
    (r"(?i) ('t)(was) ", " $1 $2 "),
]


def _rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), rules, text)


def treebank_words(marked: Column) -> Column:
    """Lower-cased words of a text whose sentences end at line feeds."""
    spaced = F.concat(F.lit(" "), _rewritten(marked, _PUNCTUATION), F.lit(" "))
    doubled = F.regexp_replace(spaced, r"\s+", "  ")
    words = F.split(F.lower(_rewritten(doubled, _CONTRACTIONS)), r"\s+")
    return F.array_remove(words, "")
