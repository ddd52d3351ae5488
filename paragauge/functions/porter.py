"""Porter stemming for the stem stage of word alignment.

The published algorithm with the extensions METEOR's stemmer uses: irregular forms, words of
one or two letters kept, four-letter ``-ies``/``-ied``, ``-alli``, ``-fulli`` and ``-logi``.
Words are looked at once per distinct word of a batch, never once per token.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Irregular words and their stems.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "news": "news", "innings": "inning", "inning": "inning", "outings": "outing",
    "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe",
    "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# Suffix and replacement, step 2 (after a stem with a vowel-consonant pair).
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
    "fulli": "ful",
}

# Step 3.
STEP3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}

# Suffixes dropped by step 4.
STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]

# Vowel/consonant shapes; y is a consonant at the start or after a vowel.
VOWEL = "^(?:[aeiou]|[^aeiou][^aeiouy]*[aeiouy])"
MEASURE_1_UP = VOWEL + "[aeiou]*[^aeiou]"
MEASURE_2_UP = MEASURE_1_UP + "[^aeiouy]*[aeiouy][aeiou]*[^aeiou]"
ENDS_CVC = "(?:(?:[^aeiouy]|^y|[aeiou]y)[aeiouy][^aeiouwxy]|^[aeiou][^aeiou])$"

_has_vowel = re.compile(VOWEL, re.S).search
_measure_1_up = re.compile(MEASURE_1_UP, re.S).search
_measure_2_up = re.compile(MEASURE_2_UP, re.S).search
_ends_cvc = re.compile(ENDS_CVC, re.S).search


def _suffix(word: str, suffixes) -> str:
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _plural(w: str) -> str:
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure_1_up(w[:-3]) else w
    stem = w.removesuffix("ed") if w.endswith("ed") else w.removesuffix("ing")
    if stem == w or not _has_vowel(stem):
        return w
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if stem[-1:] == stem[-2:-1] and stem[-1] not in "aeiou":
        return stem if stem[-1] in "lsz" else stem[:-1]
    short = _measure_1_up(stem) and not _measure_2_up(stem) and _ends_cvc(stem)
    return stem + "e" if short else stem


def _final_y(w: str) -> str:
    return w[:-1] + "i" if re.search(".[^aeiouy]y$|[aeiou]yy$", w) else w


def _replace(w: str, rules: dict[str, str]) -> str:
    suffix = _suffix(w, rules)
    stem = w.removesuffix(suffix)
    return stem + rules[suffix] if suffix and _measure_1_up(stem) else w


def _double(w: str) -> str:
    if w.endswith("alli") and _measure_1_up(w[:-4]):
        w = w[:-2]
    if w.endswith("logi"):
        return w[:-1] if _measure_1_up(w[:-3]) else w
    return _replace(w, STEP2)


def _derived(w: str) -> str:
    suffix = _suffix(w, STEP4)
    stem = w.removesuffix(suffix)
    if suffix == "ion" and stem[-1:] not in ("s", "t"):
        return w
    return stem if _measure_2_up(stem) else w


def _final_e(w: str) -> str:
    stem = w.removesuffix("e")
    keep = not _measure_2_up(stem) and (not _measure_1_up(stem) or _ends_cvc(stem))
    return w if keep else stem


def _final_ll(w: str) -> str:
    return w[:-1] if w.endswith("ll") and _measure_2_up(w[:-1]) else w


def stem(word: str) -> str:
    """Stem of a lower-cased word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) > 2:
        word = _final_y(_past(_plural(word)))
        word = _final_ll(_final_e(_derived(_replace(_double(word), STEP3))))
    return word


def _left_stems(words: pa.Array, matches: pa.Array, place) -> pa.Array:
    sizes = np.diff(words.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    found = np.diff(matches.offsets.to_numpy())
    free = np.ones(sizes.sum(), dtype=bool)
    free[np.repeat(starts, found) + place(matches.flatten().to_numpy())] = False
    coded = words.flatten().filter(pa.array(free)).dictionary_encode()
    stems = pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string())
    offsets = np.concatenate([[0], np.cumsum(sizes - found)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, stems.take(coded.indices))


@F.arrow_udf(T.ArrayType(T.StringType()))
def hyp_left_stems(words: pa.Array, matches: pa.Array) -> pa.Array:
    """Stems of the hypothesis words no match takes; a distinct word is stemmed once."""
    return _left_stems(words, matches, lambda m: m >> 32)


@F.arrow_udf(T.ArrayType(T.StringType()))
def ref_left_stems(words: pa.Array, matches: pa.Array) -> pa.Array:
    """Stems of the reference words no match takes."""
    return _left_stems(words, matches, lambda m: m & 0xFFFFFFFF)
