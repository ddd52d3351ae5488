"""Counts over whole texts that quality rules look at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge.llm import words as W

#: The counted symbols.
SYMBOLS = b"#*$%&|<>"
WIDTH = 5

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_adjacent", "n_upper", "n_digits", "n_marks", "n_chars",
]

_SYMBOL, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(SYMBOLS)] = True
_DIGIT[48:58] = True
_MARK[list(b"!?.,;:")] = True


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """All COUNTS of each text; null counts as empty."""
    data, off = W.raw(texts)
    n = len(off) - 1
    some = np.flatnonzero(off[1:] > off[:-1])

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(n, np.int64)
        if len(some):
            sums[some] = np.add.reduceat(flags.view(np.uint8), off[some], dtype=np.int32)
        return sums

    span = W.words(data, off, lower=False)
    leads = (data & 0xC0) != 0x80
    inside = ~W.SEPARATOR[data]
    out = {
        "n_words": np.bincount(span.doc, minlength=n),
        "word_chars": per_text(leads & inside),
        "n_symbols": per_text(_SYMBOL[data]),
        "n_upper": per_text(W.UPPER[data]),
        "n_digits": per_text(_DIGIT[data]),
        "n_marks": per_text(_MARK[data]),
        "n_chars": per_text(leads),
    }

    line = W.lines(data, off)
    seen = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
    wordy = np.flatnonzero(seen[line.end] > seen[line.start])
    out["n_lines"] = np.bincount(line.doc[wordy], minlength=n)
    out["n_dup_lines"] = out["n_lines"] - distinct(line.doc[wordy], line.hash[wordy], n)
    out["n_distinct"] = distinct(span.doc, span.hash, n)
    same = (span.hash[1:] == span.hash[:-1]) & (span.doc[1:] == span.doc[:-1])
    out["n_adjacent"] = np.bincount(span.doc[1:][same], minlength=n)

    at, doc, run = W.windows(span, WIDTH)
    key, _ = W.within(doc, run, n)
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        again = again[np.concatenate([[True], again[1:] != again[:-1]])]
        place = np.minimum(np.searchsorted(again, key), len(again) - 1)
        at = at[again[place] == key]
        cover = np.bincount(at, minlength=len(span.doc) + 1)
        cover -= np.bincount(at + WIDTH, minlength=len(span.doc) + 1)
        covered = np.cumsum(cover[:-1]) > 0
        out["n_repeat_words"] = np.bincount(span.doc[covered], minlength=n)
    else:
        out["n_repeat_words"] = np.zeros(n, np.int64)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def distinct(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """How many different keys each text has."""
    ordered, shift = W.within(doc, key, n)
    ordered.sort()
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.bincount((ordered[new] >> np.uint64(shift)).astype(np.int64), minlength=n)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts(texts: pa.Array) -> pa.Array:
    """All COUNTS of a text as one struct."""
    parts = [count(p.column(0)) for p in W.slices(pa.record_batch([texts], ["text"]))]
    arrays = [
        pa.array(np.concatenate([p[c] for p in parts]) if parts else [], pa.int64())
        for c in COUNTS
    ]
    return pa.StructArray.from_arrays(arrays, COUNTS)


def with_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and all COUNTS of each row's text; the text itself goes no further.

    One row for each row, in any order. A null or empty text has zero everywhere. Columns of
    ``docs`` that carry the name of a count are not in the way: only ``keep`` is returned.
    """
    clash = set(keep) & set(COUNTS)
    if clash:
        raise ValueError(f"columns named like counts: {sorted(clash)}")
    kept = [F.col(f"`{c}`") for c in keep]
    return docs.select(*kept, counts(F.col(f"`{text}`")).alias("__counts")).select(
        *kept, "__counts.*"
    )


#: What models see: shares, so that a long text is judged like a short one.
RATIOS: dict[str, tuple[str, str]] = {
    "symbol_share": ("n_symbols", "n_chars"),
    "upper_share": ("n_upper", "n_chars"),
    "digit_share": ("n_digits", "n_chars"),
    "mark_share": ("n_marks", "n_chars"),
    "word_length": ("word_chars", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "adjacent_share": ("n_adjacent", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
}
PLAIN = ["n_words", "n_lines"]
FEATURES = [*RATIOS, *PLAIN]


def feature_columns(struct: str = "") -> list[Column]:
    """FEATURES as doubles over the columns COUNTS, or over a struct of them."""

    def of(name: str) -> Column:
        return F.col(f"{struct}.{name}" if struct else name)

    shares = [
        F.when(of(b) > 0, of(a).cast("double") / of(b)).otherwise(F.lit(0.0)).alias(name)
        for name, (a, b) in RATIOS.items()
    ]
    return shares + [of(c).cast("double").alias(c) for c in PLAIN]
