"""Request sources: CSV files, file streams, keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from maskflow.operators.ranges import Ranges, ahead
from maskflow.sources.csv_blocks import read_split

REQUIRED = ("system_prompt", "prompt")

# Cell texts that count as missing.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# File parts whose offsets may be broadcast.
_BROADCAST_SPLITS = 100_000


def require_columns(df: DataFrame, names: Sequence[str] = REQUIRED) -> DataFrame:
    """``df`` itself, or ValueError if a column is missing. Runs no job."""
    if not set(names) <= set(df.columns):
        wanted = " and ".join(f"'{n}'" for n in names)
        raise ValueError(f"requests must contain {wanted} columns. Found: {df.columns}")
    return df


def normalize_text(col: Column) -> Column:
    """Missing becomes '', everything else becomes text."""
    text = col.cast("string")
    return F.when(text.isNull() | text.isin(*MISSING), F.lit("")).otherwise(text)


def _csv_options(multi_line: bool) -> dict[str, str]:
    # A quote inside quotes is doubled; an empty cell stays apart from null.
    return {"header": "true", "multiLine": str(multi_line).lower(), "escape": '"'}


def project_requests(df: DataFrame) -> DataFrame:
    """The two prompt columns, normalized; other columns are pruned."""
    require_columns(df)
    return df.select(
        *[c for c in ("request_num",) if c in df.columns],
        *[normalize_text(F.col(c)).alias(c) for c in REQUIRED],
    )


def read_requests(
    spark: SparkSession, path: str | Sequence[str], multi_line: bool | str = True
) -> DataFrame:
    """Read request CSV files: request_num, system_prompt, prompt.

    Every column is read as text. ``request_num`` counts from 1 in file order
    (files by path). Quoted line breaks need ``multi_line``, which makes a file
    one task; turn it off for large files without them. ``"split"`` reads such
    files in many tasks, if quotes stand around cells alone (``csv_blocks``).

    Numbering shuffles no text: a first pass counts the rows of each file part
    and the second adds the part's offset to the position in the part.
    """
    raw = spark.read.options(**_csv_options(bool(multi_line))).csv(path)
    require_columns(raw)
    if multi_line == "split":
        rows = read_split(spark, path, raw.columns, _csv_options(True))
        # One row per file.
        files = rows.groupBy("file").agg(F.max("record").alias("_rows"))
        earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        files = files.select("file", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_ahead"))
        number = F.col("_ahead") + F.col("record")
        return project_requests(rows.join(files, "file").select(number.alias("request_num"), *REQUIRED))
    at = F.monotonically_increasing_id()
    rows = raw.select(
        *REQUIRED,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_at", at)
    splits = rows.groupBy("_file", "_block").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    ahead = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_ahead", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)))
    # One row per file part; the plan tells how many there can be.
    if len(raw.inputFiles()) + raw.rdd.getNumPartitions() <= _BROADCAST_SPLITS:
        offsets = F.broadcast(offsets)
    number = F.col("_ahead") + F.col("_at") - F.col("_first") + 1
    numbered = rows.join(offsets.drop("_rows"), ["_file", "_block"])
    return project_requests(numbered.select(number.alias("request_num"), *REQUIRED))


def number_requests(df: DataFrame, order_by: str, parts: int | None = None) -> DataFrame:
    """Add ``request_num``, dense from 1 in the order of a key.

    Rows with the same key get consecutive numbers, in any order; a null key is
    an error. The rows are dealt by range of the key, once; a first pass counts
    the rows of each range. A key with more rows than a range has several, and
    its rows are dealt to them by a hash of all their columns (so only rows
    that are equal throughout stay together).
    """
    ranges = Ranges(df, order_by, parts, refuse_null=True)
    comparable = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    number = ranges.number(F.xxhash64(*comparable) if ranges.hot() else None)
    before = ahead(df.groupBy(number.alias("_range")).agg(F.count(F.lit(1)).alias("_ahead")), "_range", ["_ahead"])
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(order_by))
    placed = df.withColumn("_range", number).withColumn("_nth", nth)
    # One row per range: a size that is known beforehand.
    placed = placed.join(F.broadcast(before), "_range")
    return placed.withColumn("request_num", F.col("_ahead") + F.col("_nth")).drop("_range", "_nth", "_ahead")


def read_requests_stream(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Stream of request CSV files that arrive in a folder.

    ``columns``: the header of the files. By default it is read from the files
    that are there already, else request_num and the two prompts are expected.
    Columns are found by name, in any order and among others; a file with
    another header stops the stream, and so does a request without a number.
    ``files_per_batch`` bounds a micro-batch; files come in by their age.
    """
    if columns is None:
        try:
            columns = spark.read.options(**_csv_options(True)).csv(path).columns
        except AnalysisException:
            columns = ["request_num", *REQUIRED]
    wanted = ("request_num", *REQUIRED)
    if not set(wanted) <= set(columns):
        raise ValueError(f"requests must contain {wanted} columns. Found: {list(columns)}")
    schema = ", ".join(f"`{c}` {'long' if c == 'request_num' else 'string'}" for c in columns)
    options = {**_csv_options(True), "enforceSchema": "false"}
    if files_per_batch:
        options["maxFilesPerTrigger"] = str(files_per_batch)
    raw = spark.readStream.schema(schema).options(**options).csv(path)
    number = F.col("request_num")
    lost = F.raise_error(F.lit("a request has no number in request_num")).cast("long")
    return project_requests(raw.withColumn("request_num", F.when(number.isNull(), lost).otherwise(number)))
