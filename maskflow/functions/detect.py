"""Detection as column expressions (JVM only, no Python per row)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions import patterns as P

_MARK, _OTHER = "\x01\x03", "\x01\x02"
_SPANS = "array<struct<entity_type:string,start:int,end:int,value:string,pos:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain reuse of the expression inside a lambda would run it again for
    each array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add costly columns so that each row evaluates them exactly once.

    The optimizer copies an expression into every filter above it and into the
    filter it infers for an explode. It does not move anything through a
    generator that reads them, so they come out of one over a one-element array.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def may_have_pii(text: Column, entities: Sequence[str] | None = None) -> Column:
    """Cheap test that every text with a hit passes; few others do."""
    tests = [
        F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)
        for hint in P.hints(P.pick(entities))
    ]
    return F.coalesce(functools.reduce(Column.__or__, tests), F.lit(False))


def has_pii(text: Column, entities: Sequence[str] | None = None) -> Column:
    """True where ``text`` holds a hit. The cheap hint decides most rows."""
    return may_have_pii(text, entities) & text.rlike(P.spark_pattern(P.pick(entities)))


def hit_values(text: Column, entities: Sequence[str] | None = None) -> Column:
    """All hits of ``text`` from left to right; empty for null or clean text."""
    rules = P.pick(entities)
    found = F.regexp_extract_all(text, F.lit(P.spark_pattern(rules)), F.lit(P.HIT))
    none = F.array().cast("array<string>")
    return F.when(may_have_pii(text, entities), found).otherwise(none)


def gaps(text: Column, entities: Sequence[str] | None = None) -> Column:
    """The text around the hits: one piece more than there are hits.

    A regular split compiles its pattern for each row. So the hits become a
    mark of two control characters; if the text has the first one, it is
    followed by another second one there, which makes no difference to the rules.
    """
    pattern, before = P.spark_pattern(P.pick(entities)), f"${P.BEFORE}"

    def cut(t: Column) -> Column:
        return F.split(F.regexp_replace(t, F.lit(pattern), F.lit(f"{before}{_MARK}")), _MARK, -1)

    escaped = cut(F.replace(text, F.lit(_MARK[0]), F.lit(_OTHER)))
    plain = F.transform(escaped, lambda g: F.replace(g, F.lit(_OTHER), F.lit(_MARK[0])))
    return F.when(F.contains(text, F.lit(_MARK[0])), plain).otherwise(cut(text))


def entity_of(value: Column, entities: Sequence[str] | None = None) -> Column:
    """Entity type of a hit."""
    *first, last = P.pick(entities)
    kind = F.lit(last.name)
    for rule in reversed(first):
        kind = F.when(value.rlike(rule.tell), F.lit(rule.name)).otherwise(kind)
    return kind


def detect(text: Column, entities: Sequence[str] | None = None) -> Column:
    """Hits of ``text`` as an array of (entity_type, start, end, value, pos).

    ``start`` and ``end`` are half-open 0-based character offsets; ``pos``
    counts the hits from 0. The offsets come from one fold over the pieces.
    """

    def spans(both: Column) -> Column:
        sizes = F.zip_with(
            F.slice(both["gaps"], 1, F.size(both["values"])),
            both["values"],
            lambda gap, value: F.length(gap) + F.length(value),
        )

        def step(acc: Column, size: Column) -> Column:
            end = acc["at"] + size
            return F.struct(end.alias("at"), F.concat(acc["ends"], F.array(end)).alias("ends"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

        def placed(ends: Column) -> Column:
            return F.transform(
                both["values"],
                lambda value, i: F.struct(
                    entity_of(value, entities).alias("entity_type"),
                    (F.get(ends, i) - F.length(value)).alias("start"),
                    F.get(ends, i).alias("end"),
                    value.alias("value"),
                    i.alias("pos"),
                ),
            )

        return let(F.aggregate(sizes, zero, step, lambda acc: acc["ends"]), placed).cast(_SPANS)

    values = hit_values(text, entities)
    both = F.struct(values.alias("values"), gaps(text, entities).alias("gaps"))
    return F.when(has_pii(text, entities), let(both, spans)).otherwise(F.array().cast(_SPANS))
