"""Ranges of a key, cut by a sample that is a sketch: mergeable, of fixed size, taken without a shuffle.

Each row gets a hash, and the rows with the smallest hashes are kept: a
uniform sample whatever the order and the tasks, merged by keeping the smallest
again. How small they are tells how many rows there are. The bounds are
quantiles of the sample, literals of the plan, so the range of a row is a
function of the row alone: any number of plans may ask for it, and nothing is
written down.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.functions.detect import let

#: Rows of the sample; what the driver gets at most.
SAMPLE = 16_384
#: Ranges at most.
MOST = 4_096
#: Rows of a range, if that does not make too many.
ROWS = 50_000


def sketch(df: DataFrame, key: str, refuse_null: bool = False) -> tuple[list, int]:
    """The keys of ``SAMPLE`` rows at most, sorted, and about how many rows there are.

    Rows with a null key are left out, or an error.
    """
    rows = df.select(F.col(key).alias("key"))
    if not refuse_null:
        rows = rows.filter("key IS NOT NULL")
    # The row's own number makes repeated keys as frequent here as they are.
    hash_ = F.xxhash64("key", F.monotonically_increasing_id())
    hashed = rows.select("key", F.when(F.col("key").isNotNull(), hash_).alias("hash"))
    found = hashed.orderBy(F.asc_nulls_first("hash")).limit(SAMPLE).collect()
    if found and found[0]["key"] is None:
        raise ValueError(f"'{key}' is null in some rows; they have no place in the order")
    if len(found) < SAMPLE:
        return sorted(r["key"] for r in found), len(found)
    share = (found[-1]["hash"] + 2**63) / 2**64
    return sorted(r["key"] for r in found), int(len(found) / share)


class Ranges:
    """Ranges of about equal numbers of rows, by ``key``, in its order.

    A key with more rows than a range has many ranges of its own; ``number``
    deals its rows to them by a hash of the row.
    """

    def __init__(self, df: DataFrame, key: str, parts: int | None = None, refuse_null: bool = False):
        self.key, self.kind = key, df.schema[key].dataType
        keys, rows = sketch(df, key, refuse_null)
        if parts is None:
            cores = df.sparkSession.sparkContext.defaultParallelism
            parts = max(4 * cores, -(-rows // ROWS))
        parts = max(1, min(parts, MOST, len(keys)))
        self.bounds = [keys[len(keys) * i // parts] for i in range(1, parts)]

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    def hot(self) -> dict:
        """Keys with several ranges of their own: key -> (first, how many)."""
        out = {}
        for key in dict.fromkeys(b for a, b in zip(self.bounds, self.bounds[1:]) if a == b):
            first = bisect_left(self.bounds, key)
            out[key] = (first, bisect_right(self.bounds, key) - first)
        return out

    def number(self, salt: Column | None = None) -> Column:
        """The range of a row: the number of bounds up to its key, by binary search.

        With a ``salt`` (a hash), the rows of a hot key are dealt to its ranges.
        """
        key = F.col(self.key)
        if not self.bounds:
            return F.lit(0)
        bounds = F.array(*[F.lit(b) for b in self.bounds]).cast(f"array<{self.kind.simpleString()}>")
        steps = [1 << i for i in range(len(self.bounds).bit_length() - 1, -1, -1)]

        def search(known: Column) -> Column:
            def step(at: Column, size: Column) -> Column:
                ahead = at + size
                fits = (ahead <= len(self.bounds)) & (F.get(known, ahead - F.lit(1)) <= key)
                return F.when(fits, ahead).otherwise(at)

            return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)

        plain = let(bounds, search)
        hot = self.hot() if salt is not None else {}
        for value, (first, many) in hot.items():
            dealt = first + 1 + F.pmod(salt, F.lit(many)).cast("int")
            plain = F.when(key == F.lit(value).cast(self.kind), dealt).otherwise(plain)
        return plain


def ahead(totals: DataFrame, number: str, sums: Sequence[str], start: Sequence[int] | None = None) -> DataFrame:
    """Per range, the sums of all ranges before it; one row per range, so at most ``MOST``."""
    before = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    first = start or [0] * len(sums)
    return totals.select(
        number, *[(F.coalesce(F.sum(s).over(before), F.lit(0)) + F.lit(int(n))).cast("long").alias(s) for s, n in zip(sums, first)]
    )
