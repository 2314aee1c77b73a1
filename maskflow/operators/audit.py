"""Audits: the guarantees of masking and restoring as queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions import patterns as P
from maskflow.functions.detect import compute_once, has_pii
from maskflow.functions.mask import count_of
from maskflow.functions.restore import unredact
from maskflow.operators.masking import with_hits


def leaks(redacted: Column, mapping: Column) -> Column:
    """True if a masked text still holds an original, or anything that looks like one."""
    known = F.exists(F.map_values(mapping), lambda v: F.contains(redacted, v))
    return F.coalesce(known, F.lit(False)) | has_pii(redacted)


def leak_rows(masked: DataFrame) -> DataFrame:
    """Masked requests with a leak in either prompt."""
    bad = leaks(F.col("redacted_system"), F.col("mappings")) | leaks(
        F.col("redacted_user"), F.col("mappings")
    )
    return compute_once(masked, {"_bad": bad}).filter("_bad").drop("_bad")


def roundtrip_failures(masked: DataFrame) -> DataFrame:
    """Masked requests whose prompts do not come back as they were."""
    back = [
        unredact(F.col(f"redacted_{f}"), F.col("mappings")).eqNullSafe(F.col(f"original_{f}"))
        for f in ("system", "user")
    ]
    return compute_once(masked, {"_same": back[0] & back[1]}).filter("NOT _same").drop("_same")


def collides(text: Column, entities: Sequence[str] = P.ENTITIES) -> Column:
    """True if an input already holds something that looks like a placeholder."""
    return F.coalesce(text.rlike(P.token_pattern(entities)), F.lit(False))


def pii_profile(
    df: DataFrame, text: str, by: Sequence[str], entities: Sequence[str] = P.ENTITIES
) -> DataFrame:
    """Hits per type, rows and rows with hits, with subtotals over ``by``.

    ``level`` is the number of leading ``by`` columns that were summed away
    from the right (0: none); their values are null in such rows.
    """
    found = with_hits(df.select(*by, text), [text], entities)
    counted = found.select(
        *by, *[count_of(F.col(f"_t_{text}"), e).alias(e.lower()) for e in entities]
    )
    columns = [e.lower() for e in entities]
    some = F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])
    # One row per group before the subtotals multiply the rows.
    groups = counted.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(some > 0).alias("rows_with_hits"),
        *[F.sum(c).alias(c) for c in columns],
    )
    return groups.rollup(*by).agg(
        F.bit_count(F.grouping_id()).cast("long").alias("level"),
        *[F.sum(c).alias(c) for c in ("rows", "rows_with_hits", *columns)],
    )
