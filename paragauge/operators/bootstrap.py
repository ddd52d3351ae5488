"""Bootstrap intervals of mean scores."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paragauge.functions import hashing

PER_HASH = 4  # one md5 gives four 32-bit numbers, so four replicates share it
SLICE = 512  # rows whose weights are held at a time


def _weights(ids: list[str | None], seed: int, replicates: int) -> np.ndarray:
    """Weight of every id in every replicate, and 1 in a last column for the plain mean."""
    blocks = [f"{seed}|{block}" for block in range(replicates // PER_HASH)]
    digests = b"".join(
        md5((block if one is None else f"{block}|{one}").encode()).digest() for one in ids for block in blocks
    )
    drawn = hashing.poisson_weights(np.frombuffer(digests, ">u4").reshape(len(ids), replicates))
    return np.column_stack([drawn, np.ones(len(ids))])


def bootstrap_ci(
    scored: DataFrame, score: str, replicates: int = 1000, seed: int = 17, level: float = 0.95
) -> DataFrame:
    """Per model: mean, and lower, middle and upper percentile over Poisson(1) resamples.

    Weights depend only on seed, replicate and ``row_id``: every model is resampled alike, and
    a lost task draws the same again. A task multiplies scores and weights slice by slice and hands
    on its ``models x replicates`` sums, so no row fans out. A null score counts as a row of score 0;
    a model none of whose rows is drawn in a replicate has no value there.
    """
    if replicates % PER_HASH:
        raise ValueError(f"replicates must be a multiple of {PER_HASH}")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                ids, models = (part.column(c).dictionary_encode("encode") for c in ("id", "model"))
                scores = part.column("score").to_numpy(zero_copy_only=False)
                shape = len(models.dictionary), len(ids.dictionary)
                at = models.indices.to_numpy() * shape[1] + ids.indices.to_numpy()
                cells = [np.bincount(at, w, shape[0] * shape[1]) for w in (np.nan_to_num(scores), None)]
                weights = _weights(ids.dictionary.to_pylist(), seed, replicates)
                found = np.stack([c.reshape(shape) @ weights for c in cells], 1)
                for model, own in zip(models.dictionary.to_pylist(), found):
                    sums[model] = sums[model] + own if model in sums else own
        for model, (total, drawn) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([model] * len(total), pa.string()),
                    pa.array([*range(replicates), -1], pa.int32()),
                    pa.array(total),
                    pa.array(drawn),
                ],
                names=["model", "rep", "total", "drawn"],
            )

    means = (
        scored.select(
            F.col("row_id").cast("string").alias("id"), "model", F.col(score).cast("double").alias("score")
        )
        .mapInArrow(fold, "model string, rep int, total double, drawn double")
        .groupBy("model", "rep")
        .agg(F.try_divide(F.sum("total"), F.sum("drawn")).alias("value"))
    )
    tail = (1 - level) / 2
    resampled = F.when(F.col("rep") >= 0, F.col("value"))
    return (
        means.groupBy("model")
        .agg(
            F.max(F.when(F.col("rep") < 0, F.col("value"))).alias("mean"),
            F.percentile(resampled, [tail, 0.5, 1 - tail]).alias("p"),
        )
        .select(
            "model", "mean",
            F.col("p")[0].alias("low"), F.col("p")[1].alias("mid"), F.col("p")[2].alias("high"),
        )
    )
