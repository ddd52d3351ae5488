"""Exact quantiles of many columns and groups at once, by narrowing histograms.

``percentile`` keeps every different value of a group in one place; scores of rows have as many values as
rows. Here each wanted rank of each group and column has an interval that holds it. A round counts the
values of every interval in equal cells, with each cell's least and largest value, and the cell with the
rank is the next interval, cut down to its values. It ends when an interval holds one value. Cells
are counted where the rows are, so a round shuffles at most ``CELLS`` rows per interval and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paragauge.session import scratch_path

CELLS = 1024
#: Up to so many intervals are sent to every task (some 100 bytes each).
TOLD_INTERVALS = 100_000


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def long_form(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(group, variable, value) of all columns; nulls and NaN are no values."""
    entries = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in columns]))
    values = rows.select(F.col(by).alias("group"), entries.alias("e")).select("group", "e.*")
    return values.where("value IS NOT NULL AND NOT isnan(value)")


_OF = ["group", "variable"]


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["group"].eqNullSafe(b["group"]) & (a["variable"] == b["variable"])


def _cell() -> Column:
    """Number of the cell of ``value`` in the interval; infinite ends make three cells."""
    width = F.col("high") - F.col("low")
    inner = F.floor((F.col("value") - F.col("low")) / width * CELLS)
    infinite = F.when(F.col("value") == F.col("low"), 0).when(F.col("value") == F.col("high"), 2).otherwise(1)
    ends = F.abs("low") + F.abs("high") + width == float("inf")
    return F.when(ends, infinite).otherwise(F.least(inner, F.lit(CELLS - 1))).cast("int")


def _narrowed(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """One round: (group, variable, rank, before, low, high) with smaller intervals. ``before`` counts the
    values below the interval."""
    intervals = wanted.where("low < high").select(*_OF, "low", "high").distinct()
    few = intervals.count() <= TOLD_INTERVALS
    told = F.broadcast(intervals) if few else intervals
    # Intervals of one group and column are the same or apart, so a value meets one at most.
    inside = _same(values, told) & (values["value"] >= told["low"]) & (values["value"] <= told["high"])
    met = values.join(told, inside).select(values["group"], values["variable"], "value", "low", "high")
    cells = met.groupBy(*_OF, "low", "high", _cell().alias("cell")).agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    order = Window.partitionBy(*_OF, "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0)))
    place = wanted["rank"] - wanted["before"]
    hit = (
        _same(wanted, cells) & (wanted["low"] == cells["low"]) & (wanted["high"] == cells["high"])
        & (place >= cells["below"]) & (place < cells["below"] + cells["n"])
    )
    moved = wanted.join(cells, hit).select(
        wanted["group"], wanted["variable"], "rank", (F.col("before") + F.col("below")).alias("before"),
        F.col("least").alias("low"), F.col("most").alias("high"),
    )
    return wanted.where("low >= high").unionByName(moved)


def describe_by(rows: DataFrame, by: str, columns: list[str], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per value of ``by`` and column: n, mean, std, min, max and one column ``q<percent>`` per quantile,
    linearly interpolated between ranks. Exact at any number of rows; the values are stored once."""
    values = _stored(long_form(rows, by, columns), "quantile-values")
    sums = _stored(
        values.groupBy(*_OF).agg(
            F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
            F.min("value").alias("min"), F.max("value").alias("max"),
        ),
        "quantile-sums",
    )
    spots = [(F.col("n") - 1) * F.lit(float(q)) for q in quantiles]
    ranks = F.explode(F.array_distinct(F.array(*[f(s).cast("long") for s in spots for f in (F.floor, F.ceil)])))
    wanted = sums.select(*_OF, ranks.alias("rank"), F.lit(0).cast("long").alias("before"), F.col("min").alias("low"), F.col("max").alias("high"))
    wanted = _stored(wanted, "quantile-ranks")
    while not wanted.where("low < high").isEmpty():
        wanted = _stored(_narrowed(values, wanted), "quantile-ranks")
    found = wanted.groupBy(*_OF).agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("at"))
    whole = sums.join(found, _same(sums, found)).select(sums["group"], sums["variable"], "n", "mean", "std", "min", "max", "at")
    for q, spot in zip(quantiles, spots):
        low, high = F.col("at")[F.floor(spot).cast("long")], F.col("at")[F.ceil(spot).cast("long")]
        part = spot - F.floor(spot)
        value = F.when(low == high, low).otherwise(low + (high - low) * part)
        whole = whole.withColumn(f"q{round(q * 100)}", value)
    return whole.drop("at").withColumnRenamed("group", by)
