"""CSV with quoted line breaks, read in many tasks.

A file is read as lines, block by block. Whether a line begins inside quotes
depends on the parity of all quotes before it, so each block is counted for
both cases, and an exclusive or over the blocks of a file tells which case
holds. Lines that are a record by themselves go on as they are; only the
lines of longer records, and those at the ends of blocks, are brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, record, text): the records of CSV files, numbered from 0 in each; blank lines are none.

    A quote may only stand around a cell or, doubled, inside quotes. Lines end with LF or CR LF.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    here = Window.partitionBy("file", "block").orderBy("at")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    seen = F.coalesce(F.sum(quotes).over(before), F.lit(0))
    some = F.trim("value", F.lit(" \r\t")) != ""
    # Inside quotes or not, were the block to begin outside.
    lines = lines.withColumns({"odd": seen % 2, "quotes": quotes, "some": some})

    count = lambda odd: F.count_if((F.col("odd") == odd) & F.col("some"))
    blocks = lines.groupBy("file", "block").agg(
        (F.sum("quotes") % 2).alias("turns"), count(0).alias("starts_0"), count(1).alias("starts_1")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("turns").over(earlier), F.lit(0)) % 2)
    starts = F.when(F.col("inside") == 0, F.col("starts_0")).otherwise(F.col("starts_1"))
    blocks = blocks.withColumn("starts", starts)
    blocks = blocks.select("file", "block", "inside", F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("ahead"))

    lines = lines.join(blocks, ["file", "block"])
    outside = F.col("odd") == F.col("inside")
    lines = lines.filter(~outside | F.col("some")).withColumn("starts", outside)
    number = F.col("ahead") + F.sum(F.col("starts").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, 0)) - 1
    lines = lines.withColumns({"record": number, "alone": F.col("starts") & F.coalesce(F.lead("starts").over(here), F.lit(False))})
    part = F.struct("block", "at", "value")
    longer = lines.filter(~F.col("alone")).groupBy("file", "record").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    longer = longer.select("file", "record", F.array_join("parts.value", "\n").alias("text"))
    whole = lines.filter("alone").select("file", "record", F.col("value").alias("text")).unionByName(longer)
    return whole.withColumn("text", F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))


def read_split(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], options: dict[str, str]) -> DataFrame:
    """(file, record, and the columns of the header as text): the rows of CSV files with the same header, from 1 in each."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    parse = {k: v for k, v in options.items() if k not in ("header", "multiLine")}
    rows = read_records(spark, path).filter("record > 0")
    return rows.select("file", "record", F.from_csv("text", F.lit(schema), parse).alias("row")).select("file", "record", "row.*")
