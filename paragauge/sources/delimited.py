"""TSV and CSV at the edges; Parquet is the storage form inside.

Files follow the usual spreadsheet rules: a header row, fields quoted with doubled quotes, line
ends allowed inside quotes. One task reads such a file here; ``ranges.read_ranges`` reads a large one
by many, and ``multi_line=False`` does where no field holds a line end.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paragauge.functions.text import null_if_na
from paragauge.session import scratch_path

TAB = "\t"
_EXTRA, _RAW = "_extra", "_raw"


def _reader(spark: SparkSession, sep: str, header: bool = True, multi_line: bool = True):
    return (
        spark.read.option("sep", sep)
        .option("header", header)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        # Only an unquoted empty field is null; a quoted one is empty text.
        .option("nullValue", "\0")
    )


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    sep: str = TAB,
    na: str | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Read with an explicit schema; ``na="pandas"`` turns missing-value tokens into null."""
    df = _reader(spark, sep, multi_line=multi_line).schema(schema).csv(path)
    if na == "pandas":
        df = df.withColumns(
            {
                f.name: null_if_na(F.col(f.name))
                for f in schema.fields
                if isinstance(f.dataType, T.StringType)
            }
        )
    return df


def read_skipping_bad_lines(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected raw lines). A line with too many fields is bad; a short one is
    padded with nulls. Both frames are lazy, so count the second one to report it."""
    extended = T.StructType(
        [
            *schema.fields,
            T.StructField(_EXTRA, T.StringType()),
            T.StructField(_RAW, T.StringType()),
        ]
    )
    df = _reader(spark, sep, header).option("columnNameOfCorruptRecord", _RAW).schema(extended).csv(path)
    # Against one field too many in the schema, a regular line is flagged as short and keeps its
    # raw text; a line without raw text filled the extra field. Beyond that, count separators
    # outside quoted fields.
    char = "\\t" if sep == TAB else f"\\{sep}"
    unquoted = F.regexp_replace(_RAW, rf'(?s)(?<=^|{char}|\n)"(?:[^"]++|"")*+"(?={char}|\r?\n?$)', "")
    separators = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit("")))
    bad = F.col(_RAW).isNull() | (separators >= len(schema.fields))
    # Every field is read, whatever is asked for: the parser judges a line by the fields it reads.
    read = F.length(F.concat_ws(sep, *[F.col(c).cast("string") for c in [*schema.fieldNames(), _EXTRA]]))
    good = df.where(~bad & (read >= 0)).select(schema.fieldNames())
    rejected = df.where(bad & (read >= 0)).select(
        F.coalesce(_RAW, F.concat_ws(sep, *schema.fieldNames(), _EXTRA)).alias("line")
    )
    return good, rejected


def write_delimited(
    df: DataFrame, path: str, sep: str = TAB, empty: str = "keep", mode: str = "errorifexists"
) -> None:
    """Write without an index column and without trimming.

    ``empty="keep"`` quotes empty text so that it differs from null when read back;
    ``empty="pandas"`` writes nothing for both.
    """
    (
        df.write.mode(mode)
        .option("sep", sep)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", '""' if empty == "keep" else "")
        .option("nullValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def with_row_id(files: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a file scan 0, 1, 2, ... by file name and place in the file.

    The rows are first stored with the scan's own increasing ids, in the shared scratch folder:
    a second scan could pack splits into other tasks. Rows of one split keep their order, so a
    row's number is its split's offset plus its distance from the split's first row. Only one
    count per split reaches the driver, which planned the splits in the first place.
    """
    spark = files.sparkSession
    scanned = files.withColumns(
        {
            "_file": F.col("_metadata.file_path"),
            "_start": F.col("_metadata.file_block_start"),
            "_at": F.monotonically_increasing_id(),
        }
    )
    path = scratch_path(spark, "numbered")
    scanned.write.parquet(path)
    placed = spark.read.schema(scanned.schema).parquet(path)
    return numbered(placed, "_file", "_start", "_at", name).select(name, *files.columns)


#: Offsets of up to so many splits are sent to every task (some 200 bytes each).
TOLD_SPLITS = 50_000


def numbered(placed: DataFrame, file: str, start: str, at: str, name: str) -> DataFrame:
    """Rows numbered by file name, split and place; the places ``at`` of a split have no gaps.

    Few offsets are told to every task, so that no text is shuffled; more are joined.
    """
    splits = placed.groupBy(file, start).agg(F.count("*"), F.min(at)).collect()
    rows = sorted(map(tuple, splits))
    before = [0, *accumulate(n for _, _, n, _ in rows)]
    offsets = placed.sparkSession.createDataFrame(
        [(path, first, offset - place) for (path, first, _, place), offset in zip(rows, before)],
        f"{file} string, {start} bigint, _shift bigint",
    )
    offsets = F.broadcast(offsets) if len(rows) <= TOLD_SPLITS else offsets.hint("merge")
    found = placed.join(offsets, [file, start]).withColumn(name, F.col(at) + F.col("_shift"))
    return found.select(name, *[c for c in placed.columns if c not in (file, start, at)])
