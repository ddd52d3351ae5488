"""Parallel pairs from a table of conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_from_turns(turns: DataFrame) -> DataFrame:
    """A user turn and the assistant turn right after it as ``(row_id, source, target)``.

    Joined on the turn number rather than found with a window per conversation, so one
    conversation holding most turns spreads over all tasks.
    """
    user = turns.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("source"), (F.col("turn") + 1).alias("next")
    )
    reply = turns.where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("next"), F.col("text").alias("target")
    )
    row_id = F.col("conv_id") * F.lit(1 << 32) + F.col("turn")
    return user.join(reply, ["conv_id", "next"]).select(
        row_id.alias("row_id"), "source", "target"
    )
