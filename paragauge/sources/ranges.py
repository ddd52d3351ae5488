"""A large delimited file with quoted line ends, read by many tasks.

Spark cuts a text file into byte ranges at line ends, but a line may begin inside a quoted field.
Whether it does depends on everything before it, in a simple way: a line takes the state at its start,
outside or inside quotes, to the state at its end, and so does a whole range.

1. One pass finds for each range its end state for either start state, by the lines with quotes only.
2. The states of a file's ranges follow from a running sum over them (a few numbers per range): the
   last range with the same end for both starts decides, and each later one that swaps turns it over.
3. A second pass knows the state at the start of each range, so every task joins its own lines to
   records. Pieces of a record that runs over the end of a range are put together after.
4. Records are parsed by Spark's CSV functions and numbered by range and place.

The file must stay as it is between the passes. A record must fit into memory, a file need not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge.functions.text import null_if_na
from paragauge.operators.results import quoted
from paragauge.session import scratch_path
from paragauge.sources.delimited import TAB, numbered

#: Up to so many ranges their states are sent to every task (some 200 bytes each).
TOLD_RANGES = 50_000
#: Ranges that are asked for grow with the files beyond so many, until they have LARGEST_RANGE bytes: each one
#: costs a task in both passes and a stored file.
MOST_RANGES = 256
LARGEST_RANGE = 128 << 20

_ENDS = "file string, start long, from_outside long, from_inside long, touches boolean"
_RECORD = "file string, start long, place long, owner long, line string"


def line_rules(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """Whether a line that starts outside, or inside, a quoted field ends inside one.

    Only a quote at the beginning of a field opens it; inside, a doubled quote stands for itself; what
    follows the closing quote belongs to the field up to the separator.
    """
    s = re.escape(sep)
    inner = r'[^"]*+(?:""[^"]*+)*+'
    field = rf'(?:"{inner}"(?!")[^{s}]*+|[^"{s}][^{s}]*+)?+'
    opened = rf'(?:{field}{s})*+"{inner}\Z'
    return re.compile(rf"(?s){opened}"), re.compile(rf'(?s){inner}(?:\Z|"[^{s}]*+{s}{opened})')


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and the start of their byte range, in the order of the file within one."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta.file_path.alias("file"), meta.file_block_start.alias("start"), F.col("value").alias("line")
    )


def _ends(lines: DataFrame, sep: str) -> DataFrame:
    """Per range its end state for either start state, and whether a line starts outside quotes if the
    range starts inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = line_rules(sep)
        ranges: dict[tuple[str, int], list] = {}
        for batch in batches:
            places = zip(batch.column("file").to_pylist(), batch.column("start").to_pylist())
            for place, line in zip(places, batch.column("line").to_pylist()):
                state = ranges.setdefault(place, [0, 1, False])
                if line is not None:
                    for k in (0, 1):
                        state[k] = int(rules[state[k]].match(line) is not None)
                    state[2] |= not state[1]
        rows = [(*place, *state) for place, state in ranges.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), names=_names(_ENDS))

    # Lines without quotes change nothing, so their text stays where it is.
    quoted = lines.withColumn("line", F.when(F.col("line").contains('"'), F.col("line")))
    return quoted.mapInArrow(run, _ENDS)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def range_states(ends: DataFrame) -> DataFrame:
    """Per range (file, start): ``inside``, the state at its start, and ``owner``, the range in which
    the record that is open there began."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_outside") == F.col("from_inside")
    swaps = F.when(F.col("from_outside") > F.col("from_inside"), 1).otherwise(0)
    counted = ends.withColumn("swaps", F.sum(swaps).over(order))
    # The state after a fixed range, as it would be had there been no swap before.
    base = F.when(fixed, F.col("from_outside").bitwiseXOR((F.col("swaps") % 2).cast("long")))
    turned = (F.coalesce(F.last("swaps").over(before), F.lit(0)) % 2).cast("long")
    state = F.coalesce(F.last("base", ignorenulls=True).over(before), F.lit(0).cast("long")).bitwiseXOR(turned)
    known = counted.withColumn("base", base).withColumn("inside", state)
    opens = F.when(F.col("inside") == 0, F.col("from_outside") == 1).otherwise(
        (F.col("from_inside") == 1) & F.col("touches")
    )
    owner = F.last(F.when(opens, F.col("start")), ignorenulls=True).over(before)
    return known.withColumn("owner", owner).select("file", "start", "inside", "owner")


def _records(lines: DataFrame, sep: str) -> DataFrame:
    """Records and pieces of records, by range and place. ``owner`` is null for a whole record, else
    the range in which it began; the piece there has that range's own start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = line_rules(sep)
        here, place, open_, inside, owner, out = None, 0, [], 0, None, []

        def close(piece: bool) -> None:
            nonlocal place, owner
            if open_ and (piece or open_ not in ([""], ["\r"])):  # a blank line is no record
                begun = owner if owner is not None else here[1] if piece else None
                out.append((*here, place, begun, "\n".join(open_)))
                place += 1
            open_.clear()
            owner = None

        def batch_of() -> pa.RecordBatch:
            columns = zip(_names(_RECORD), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()], zip(*out))
            made = pa.RecordBatch.from_pydict({name: pa.array(c, kind) for name, kind, c in columns})
            out.clear()
            return made

        for batch in batches:
            quoted = pc.match_substring(batch.column("line"), '"').to_pylist()
            places = zip(batch.column("file").to_pylist(), batch.column("start").to_pylist())
            states = zip(batch.column("inside").to_pylist(), batch.column("owner").to_pylist())
            for at, line, marks, state in zip(places, batch.column("line").to_pylist(), quoted, states):
                if at != here:
                    if here is not None:
                        close(piece=True)
                    here, place, inside = at, 0, state[0]
                    owner = state[1] if inside else None
                open_.append(line)
                if marks:
                    inside = int(rules[inside].match(line) is not None)
                if not inside:
                    close(piece=False)
            if out:
                yield batch_of()
        if here is not None:
            close(piece=True)
        if out:
            yield batch_of()

    return lines.mapInArrow(run, _RECORD)


def read_ranges(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = TAB,
    na: str | None = None,
    header: bool = True,
    row_id: str | None = None,
    split_bytes: int | None = None,
) -> DataFrame:
    """The rows that ``read_delimited`` gives, by as many tasks as the files have byte ranges.

    With ``row_id`` they are numbered 0, 1, 2, ... by file name and place. ``split_bytes`` asks for
    smaller ranges than the session's ``spark.sql.files.maxPartitionBytes``; files of more than
    ``MOST_RANGES`` such ranges are read by larger ones. Blank lines between records
    are skipped; the first record of each file is its header. The records are stored in the shared
    scratch folder.
    """
    path_of = scratch_path(spark, "records")
    with _splits(spark, split_bytes and _range_bytes(spark, path, split_bytes)):
        lines = _lines(spark, path)
        states_path = scratch_path(spark, "ranges")
        range_states(_ends(lines, sep)).write.parquet(states_path)
        states = spark.read.schema("file string, start long, inside long, owner long").parquet(states_path)
        if states.count() <= TOLD_RANGES:
            told = lines.join(F.broadcast(states), ["file", "start"])
        else:
            ordered = lines.withColumn("at", F.monotonically_increasing_id())
            told = ordered.join(states.hint("merge"), ["file", "start"]).sortWithinPartitions("file", "start", "at")
        _records(told.select("file", "start", "line", "inside", "owner"), sep).write.parquet(path_of)
    stored = spark.read.schema(_RECORD).parquet(path_of)
    whole = stored.where("owner IS NULL").drop("owner")
    pieces = stored.where("owner IS NOT NULL")
    first = F.when(F.col("start") == F.col("owner"), F.col("place"))
    joined = pieces.groupBy("file", "owner").agg(
        F.max(first).alias("place"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "line"))), lambda p: p.line), "\n").alias("line"),
    )
    records = whole.unionByName(joined.withColumnRenamed("owner", "start"))
    if header:
        records = records.where("NOT (start = 0 AND place = 0)")
    records = records.withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": "\0"}
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    parsed = records.withColumn("_row", F.from_csv("line", columns, options))
    fields = [F.col("_row").getField(f.name).alias(f.name) for f in schema.fields]
    if na == "pandas":
        text = [isinstance(f.dataType, T.StringType) for f in schema.fields]
        fields = [null_if_na(c).alias(f.name) if t else c for c, f, t in zip(fields, schema.fields, text)]
    if row_id is None:
        return parsed.select(*fields)
    return numbered(parsed.select("file", "start", "place", *fields), "file", "start", "place", row_id)


def _range_bytes(spark: SparkSession, path: str, asked: int) -> int:
    """The size asked for, or the one that gives ``MOST_RANGES`` ranges. Only lengths of files are read."""
    length = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return max(asked, min(-(-length // MOST_RANGES), LARGEST_RANGE))


class _splits:
    """Smaller byte ranges for the scans that run inside."""

    SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def __init__(self, spark: SparkSession, size: int | None):
        self.spark, self.size = spark, size

    def __enter__(self) -> None:
        self.usual = {k: self.spark.conf.get(k) for k in self.SETTINGS}
        if self.size:
            self.spark.conf.set(self.SETTINGS[0], str(self.size))
            self.spark.conf.set(self.SETTINGS[1], str(min(self.size, 4 << 20)))

    def __exit__(self, *_) -> None:
        for k, v in self.usual.items():
            self.spark.conf.set(k, v)
