"""Masking of table columns: request scope, session scope, vault, totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.functions import detect as D
from maskflow.functions import mask as M
from maskflow.functions import patterns as P
from maskflow.operators.ranges import Ranges, ahead


def _names(entities: Sequence[str] | None) -> list[str]:
    return [e for e in P.ENTITIES if entities is None or e in entities]


def _seen(field: str, only: Column | None) -> Column:
    return F.col(field) if only is None else F.when(only, F.col(field))


def with_hits(
    df: DataFrame, fields: Sequence[str], entities=None, only: Column | None = None
) -> DataFrame:
    """Add ``_v_<field>`` (hits) and ``_t_<field>`` (their types).

    The pattern runs once per text.
    """
    out = D.compute_once(
        df, {f"_v_{f}": D.hit_values(_seen(f, only), entities) for f in fields}
    )
    return out.withColumns(
        {f"_t_{f}": F.transform(f"_v_{f}", lambda v: D.entity_of(v, entities)) for f in fields}
    )


def count_hits(
    df: DataFrame, key: str, fields: Sequence[str], entities=None, only: Column | None = None
) -> DataFrame:
    """Hits per type of each row that has any: key and one LONG per type."""
    names = _names(entities)
    some = F.lit(False)
    for f in fields:
        some = some | D.may_have_pii(_seen(f, only), entities)
    found = with_hits(df.filter(some), fields, entities, only)
    hits = F.lit(0)
    for f in fields:
        hits = hits + F.size(f"_v_{f}")
    types = F.concat(*[F.col(f"_t_{f}") for f in fields])
    return found.filter(hits > 0).select(
        key, *[M.count_of(types, n).alias(n) for n in names]
    )


def _hit_counts(fields: Sequence[str], names: Sequence[str]) -> dict[str, Column]:
    types = F.concat(*[F.col(f"_t_{f}") for f in fields])
    return {f"_c_{n}": M.count_of(types, n) for n in names}


def _session(
    df: DataFrame,
    key: str,
    fields: Sequence[str],
    entities,
    start: Mapping[str, int],
    parts: int | None,
    only: Column | None,
    dirty: Column,
) -> DataFrame:
    """Rows that may have hits (``dirty``), with ``with_hits`` columns and ``_used_<type>``.

    The table is cut into ranges of the key. A first pass adds up the hits of
    each range: one row per range. Then the rows that may have hits are dealt
    by range, and a window runs over each range from what the ranges before used.
    """
    names = _names(entities)
    ranges = Ranges(df, key, parts)
    number = ranges.number()
    counts = count_hits(df, key, fields, entities, only)
    totals = counts.groupBy(number.alias("_range")).agg(*[F.sum(n).alias(f"_used_{n}") for n in names])
    before = ahead(totals, "_range", [f"_used_{n}" for n in names], [start.get(n, 0) for n in names])
    # Every range gets a row, as one without hits may hold rows that only seemed to have some.
    every = df.sparkSession.range(ranges.count).select(F.col("id").cast("int").alias("_range"))
    before = every.join(before, "_range", "left").select("_range", *[F.col(f"_used_{n}").alias(f"_before_{n}") for n in names])

    found = with_hits(df.filter(dirty).withColumn("_range", number), fields, entities, only)
    found = found.withColumns(_hit_counts(fields, names))
    order = Window.partitionBy("_range").orderBy(key)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    has = F.greatest(*[F.col(f"_c_{n}") for n in names], F.lit(0)) > 0
    lost = has & (F.col(key).isNull() | F.coalesce(F.lag(key).over(order) == F.col(key), F.lit(False)))
    error = F.raise_error(F.lit(f"'{key}' must be unique and not null in rows with hits")).cast("boolean")
    used = {f"_used_{n}": F.coalesce(F.sum(f"_c_{n}").over(earlier), F.lit(0)) for n in names}
    # At most one row per range: a size that is known beforehand.
    placed = found.withColumns({**used, "_lost": F.when(lost, error)}).join(F.broadcast(before), "_range", "left")
    first = F.coalesce("_lost", F.lit(True))
    return placed.withColumns(
        {f"_used_{n}": F.when(first, F.col(f"_used_{n}") + F.coalesce(f"_before_{n}", F.lit(0))) for n in names}
    ).drop("_range", "_lost", *[f"_before_{n}" for n in names], *[f"_c_{n}" for n in names])


def _masked(found: DataFrame, fields: Sequence[str], entities) -> DataFrame:
    """Number and splice; expects ``with_hits`` columns and ``_used_<type>``."""
    names = _names(entities)
    out = found
    for i, field in enumerate(fields):
        used = []
        for n in names:
            before = F.col(f"_used_{n}")
            for earlier in fields[:i]:
                before = before + M.count_of(F.col(f"_t_{earlier}"), n)
            used.append(before)
        out = out.withColumn(f"_n_{field}", M.placeholders(F.col(f"_t_{field}"), names, used))
    masked = {
        f"redacted_{f}": F.when(
            F.size(f"_v_{f}") > 0,
            M.splice(D.gaps(F.col(f), entities), F.col(f"_n_{f}")),
        ).otherwise(F.col(f))
        for f in fields
    }
    kept = F.concat(
        *[M.entries(f, F.col(f"_t_{f}"), F.col(f"_n_{f}"), F.col(f"_v_{f}")) for f in fields]
    )
    out = out.withColumns({**masked, "entries": kept})
    return out.drop(
        *[f"_{c}_{f}" for c in "vtn" for f in fields], *[f"_used_{n}" for n in names]
    )


def mask_fields(
    df: DataFrame,
    key: str,
    fields: Sequence[str],
    scope: str = "request",
    entities: Sequence[str] | None = None,
    start: Mapping[str, int] | None = None,
    parts: int | None = None,
    only: Column | None = None,
) -> DataFrame:
    """Add ``redacted_<field>`` for each text column and ``entries``.

    Fields are visited in the given order, each from its last hit to its
    first. ``scope='request'`` restarts the numbers in each row: a projection
    without any shuffle. ``scope='session'`` numbers over the whole table in
    ``key`` order (unique and not null, else the query fails), going on from the
    ``start`` counters; it takes a sample of the keys at once, and reads the
    texts twice, for the hits of each range of keys and to mask them.
    Rows for which ``only`` does not hold (e.g. other languages) stay as they are.
    """
    names = _names(entities)
    start = start or {}
    if scope == "request":
        plain = df.withColumns({f"_used_{n}": F.lit(0).cast("long") for n in names})
        return _masked(with_hits(plain, fields, entities, only), fields, entities)
    if scope != "session":
        raise ValueError("scope must be 'request' or 'session'")

    # Texts without a sign of a hit stay where they are.
    dirty = F.lit(False)
    for f in fields:
        dirty = dirty | D.may_have_pii(_seen(f, only), entities)
    found = _session(df, key, fields, entities, start, parts, only, dirty)
    clean = df.filter(~dirty).withColumns(
        {
            **{f"redacted_{f}": F.col(f) for f in fields},
            "entries": F.array().cast(f"array<{M.ENTRY}>"),
        }
    )
    return _masked(found, fields, entities).unionByName(clean)


def mask_column(
    df: DataFrame,
    key: str,
    text: str,
    scope: str = "session",
    entities: Sequence[str] | None = None,
    parts: int | None = None,
    only: Column | None = None,
) -> DataFrame:
    """``mask_fields`` for one text column of a corpus."""
    return mask_fields(df, key, [text], scope, entities, parts=parts, only=only)


def mask_requests(
    df: DataFrame,
    scope: str = "session",
    entities: Sequence[str] | None = None,
    start: Mapping[str, int] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Mask both prompts of (request_num, system_prompt, prompt).

    Gives request_num, original_system, original_user, redacted_system,
    redacted_user, entries, mappings. The system prompt is numbered first.
    """
    named = df.select(
        "request_num",
        F.col("system_prompt").alias("system"),
        F.col("prompt").alias("user"),
    )
    masked = mask_fields(
        named, "request_num", ["system", "user"], scope, entities, start, parts
    )
    return masked.select(
        "request_num",
        F.col("system").alias("original_system"),
        F.col("user").alias("original_user"),
        "redacted_system",
        "redacted_user",
        "entries",
        M.mapping(F.col("entries")).alias("mappings"),
    )


def vault(masked: DataFrame, key: str = "request_num") -> DataFrame:
    """Placeholder -> original in long form, in visiting order per key.

    Sensitive; nothing here writes it.
    """
    rows = masked.select(key, F.posexplode_outer("entries").alias("ord", "e"))
    return rows.filter(F.col("ord").isNotNull()).select(
        key, "e.field", "ord", "e.placeholder", "e.entity_type", "e.original"
    )


def entity_totals(
    df: DataFrame, fields: Sequence[str], entities: Sequence[str] | None = None
) -> DataFrame:
    """Counter values after a run: one row per type, 0 for absent types."""
    names = _names(entities)
    found = with_hits(df.select(*fields), fields, entities)
    types = F.concat(*[F.col(f"_t_{f}") for f in fields])
    sums = found.select(types.alias("_t")).agg(
        *[F.coalesce(F.sum(M.count_of(F.col("_t"), n)), F.lit(0)).alias(n) for n in names]
    )
    return sums.unpivot([], names, "entity_type", "hits")


def hit_rows(
    df: DataFrame, key: str, text: str, entities: Sequence[str] | None = None
) -> DataFrame:
    """Long view of the hits: key, pos, entity_type, start, end, value."""
    # A plain explode would detect once more, in the filter inferred for it.
    once = D.compute_once(df.select(key, text), {"_hits": D.detect(F.col(text), entities)})
    found = once.select(key, F.explode("_hits").alias("h"))
    return found.select(
        key, "h.pos", "h.entity_type", "h.start", "h.end", "h.value"
    )
