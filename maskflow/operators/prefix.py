"""Running totals and lookups that hold when one key has most of the rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.session import materialize

# One task sorts this many narrow rows in a few seconds and spills if need be.
ROWS_PER_PART = 2_000_000
MAX_PARTS = 20_000
_PART = "_part"


def _ahead(name: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    window = Window.partitionBy(*keys).orderBy(*order)
    window = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(window), F.lit(0)).cast("long")


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, str],
    group: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Add, for each ``{new: measure}``, the sum of ``measure`` over the earlier rows.

    Earlier means the same ``group`` (all rows without one) and a smaller
    ``order``; (group, order) must be unique and not null.

    While no group has more than ``ROWS_PER_PART`` rows, this is one window
    over the groups. A window would put a larger group, and without a group
    the whole table, into one task. Then the keys and measures are written
    down and cut into ranges of (group, order), which ignore group limits;
    each range sums up by itself, and a table with one row per range (at most
    ``MAX_PARTS``) carries the totals on. Other columns of ``df`` come back by
    a join on the keys.
    """
    keys = [*group, *order]
    if group and parts is None:
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        if (sizes.agg(F.max("_n")).first()[0] or 0) <= ROWS_PER_PART:
            parts = 1
    if group and parts == 1:
        return df.withColumns({n: _ahead(m, group, order) for n, m in sums.items()})

    narrow = list(dict.fromkeys([*keys, *sums.values()]))
    rows = materialize(df.select(*narrow), "totals")
    # Repeated or null keys would multiply or lose rows in the join below.
    lost = F.col("_n") > 1
    for k in keys:
        lost = lost | F.col(k).isNull()
    if rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(lost).limit(1).count():
        raise ValueError(f"{keys} must be unique and not null")
    if parts is None:
        parts = max(1, min(MAX_PARTS, math.ceil(rows.count() / ROWS_PER_PART)))
    out = _ranged(rows, keys, group, order, sums, parts)
    if set(df.columns) == set(narrow):
        return out.select(*df.columns, *sums)
    return df.join(out.select(*keys, *sums), keys).select(*df.columns, *sums)


def _ranged(
    rows: DataFrame,
    keys: list[str],
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
    parts: int,
) -> DataFrame:
    if parts == 1:
        return rows.withColumns({n: _ahead(m, group, order) for n, m in sums.items()})

    # The range bounds are sampled, so the ranges are written down before two
    # plans read them.
    ranged = rows.repartitionByRange(parts, *keys).withColumn(_PART, F.spark_partition_id())
    placed = materialize(ranged, "ranges")
    totals = placed.groupBy(_PART).agg(*[F.sum(m).alias(n) for n, m in sums.items()])
    carried = totals.select(
        _PART, *[_ahead(n, (), [_PART]).alias(f"_carry_{n}") for n in sums]
    )
    local = placed.withColumns({n: _ahead(m, [_PART], keys) for n, m in sums.items()})
    running = local.join(F.broadcast(carried), _PART).withColumns(
        {n: F.col(n) + F.col(f"_carry_{n}") for n in sums}
    )
    running = running.drop(*[f"_carry_{n}" for n in sums])
    if not group:
        return running.drop(_PART)

    # Take off what stood at the start of the group. A group that runs over a
    # range limit is the last group of the range it starts in.
    first = Window.partitionBy(_PART, *group).orderBy(*order)
    first = first.rowsBetween(Window.unboundedPreceding, 0)
    running = running.withColumns({f"_base_{n}": F.first(n).over(first) for n in sums})
    last = running.groupBy(_PART).agg(
        F.max(F.struct(*keys, *[F.col(f"_base_{n}") for n in sums])).alias("_last")
    )
    starts = last.groupBy(*[F.col(f"_last.{g}").alias(g) for g in group]).agg(
        *[F.min(f"_last._base_{n}").alias(f"_start_{n}") for n in sums]
    )
    out = running.join(F.broadcast(starts), list(group), "left").withColumns(
        {n: F.col(n) - F.coalesce(f"_start_{n}", f"_base_{n}") for n in sums}
    )
    return out


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Left join ``rows`` to ``table``, which is unique on ``keys``.

    A key that n > ``hot_rows`` rows ask for is salted: its rows go to
    n / hot_rows tasks by a hash of ``spread``, and its table row is repeated
    for each. Both the hot keys and the repeated rows number at most
    rows / hot_rows; whether the list of hot keys is broadcast is left to its size.
    """
    salts = F.ceil(F.count(F.lit(1)) / hot_rows).cast("int")
    hot = rows.groupBy(*keys).agg(salts.alias("_salts")).filter(F.col("_salts") > 1)
    salt = F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")
    left = rows.join(hot, list(keys), "left").withColumn("_salt", F.coalesce(salt, F.lit(0)))
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = table.join(hot, list(keys), "left").withColumn("_salt", F.explode(copies))
    joined = left.drop("_salts").join(right.drop("_salts"), [*keys, "_salt"], "left")
    return joined.drop("_salt")
