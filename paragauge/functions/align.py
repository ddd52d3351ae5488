"""Word alignment of one translation pair: match codes, left-over words, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 1 << 32


def no_matches() -> Column:
    return F.array().cast("array<bigint>")


def hyp_position(match: Column) -> Column:
    return F.shiftright(match, 32).cast("int")


def ref_position(match: Column) -> Column:
    return match.bitwiseAND(F.lit(_SHIFT - 1)).cast("int")


def left_positions(size: Column, taken: Column) -> Column:
    """Positions 0..size-1 that are not among ``taken``, in text order."""
    everything = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_except(everything, taken)


def at_positions(matches: Column, hyp: Column, ref: Column) -> Column:
    """Matches between left-over words, as matches between the texts they were left over from."""
    return F.transform(
        matches,
        lambda m: F.get(hyp, hyp_position(m)).cast("long") * F.lit(_SHIFT)
        + F.get(ref, ref_position(m)),
    )


def chunk_count(matches: Column) -> Column:
    """Runs of matches that are consecutive on both sides."""
    shifted = F.transform(matches, lambda m: m + F.lit(_SHIFT + 1))
    return F.size(matches) - F.size(F.array_intersect(matches, shifted))
