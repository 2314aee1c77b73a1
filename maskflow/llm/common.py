"""What several operators share: words, written tables, groups in bounded blocks, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.session import new_path

#: White space that ends a word, and a word, as patterns.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: The same white space as characters.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def word_array(text: Column) -> Column:
    """The words of a text, in order; empty for a null text."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS[1:], " " * 5)
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of a text as long, without building them; 0 for a null text."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marked, SPACE_CHARS, "")).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has not."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` into the shared folder; the table read back, and its path.

    Cuts the lineage: whatever executor is lost later, the rows are there.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove_table(spark: SparkSession, path: str) -> None:
    """Delete a table of ``write_table`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes that have an edge; component: the smallest node reached.

    Alternates the large-star and the small-star step until the edges stay as
    they are; each is a partial aggregate and a join, so a hub of any degree
    is split by the skew handling of joins. Edges go to a table per round, and
    the table of the round before is deleted. Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    now, path = write_table(
        ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    told = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == told or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v"), F.col("v"))
            ).distinct()
        told = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        before = path
        now, path = write_table(small.select("e.*").filter("u <> v").distinct(), "edges")
        remove_table(spark, before)


def in_blocks(rows: DataFrame, keys: Sequence[str], salt: Column, block: int) -> DataFrame:
    """Rows with ``lo``, ``hi`` and ``part``: groups of about two blocks at most.

    Groups of ``keys`` over ``block`` rows are dealt into blocks by ``salt``
    (a hash), and a row goes to every pair (lo, hi) of blocks that holds its
    own, ``part``. So all pairs of a group meet, once each if ``lo = hi`` pairs
    are taken within and others across, and no task holds a whole large group.
    Groups of one row are dropped.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    dealt = rows.join(sizes, keys).withColumn("_b", blocks).withColumn("part", F.pmod(salt, F.col("_b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    return (
        dealt.select("*", other.alias("_o"))
        .withColumn("lo", F.least("part", "_o"))
        .withColumn("hi", F.greatest("part", "_o"))
        .drop("_n", "_b", "_o")
    )


def groups_of(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows that are sorted by ``keys``, across batches; a group must fit in memory."""
    keys = list(keys)
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        frame = pd.concat([*held, batch], ignore_index=True) if held else batch
        new = np.zeros(len(frame), dtype=bool)
        for k in keys:
            values = frame[k].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield frame.iloc[i:j]
        held = [frame.iloc[cuts[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (member, root) that connect what the pairs (a, b) of 0..n-1 connect."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    touched = np.unique(np.concatenate([a, b]))
    return [(int(x), int(root[x])) for x in touched if root[x] != x]
