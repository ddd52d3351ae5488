"""Deterministic pseudo-random keys: the same on every run, engine and partitioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cumulative probabilities of the Poisson distribution with mean 1.
POISSON_CDF = [
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119,
]


def random_key(seed: int, *parts: Column) -> Column:
    """md5 over the seed and the parts: 32 hex digits, uniformly spread."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def leading_int(key: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("long")


def poisson_weights(numbers: np.ndarray) -> np.ndarray:
    """How often a row is drawn in one bootstrap replicate (0 to 7), from 32-bit numbers."""
    limits = [math.ceil(p * 2**32) for p in POISSON_CDF]
    return np.searchsorted(np.array(limits, np.uint32), numbers.astype(np.uint32), "right")
