"""Masking as column expressions: numbers, placeholders, splicing, mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskflow.functions.detect import let

EMPTY_MAP = "map<string,string>"
ENTRY = "struct<field:string,entity_type:string,placeholder:string,original:string>"


def placeholder(entity_type: Column, number: Column) -> Column:
    """``TYPE_0001``; at least four digits, more when the number needs them."""
    return F.format_string("%s_%04d", entity_type, number)


def count_of(types: Column, entity: str) -> Column:
    return F.size(F.filter(types, lambda t: t == F.lit(entity))).cast("long")


def ranks(types: Column, entities: Sequence[str], used: Sequence[Column]) -> Column:
    """Numbers of a text's hits, in text order.

    Within a text the last hit of a type has the lowest number, so each type is
    ranked from the right, starting after the ``used`` numbers. Linear in the
    number of hits, but for the final sort.
    """
    at = F.transform(types, lambda t, i: F.struct(i.alias("i"), t.alias("t")))

    def ranked(entity: str, start: Column) -> Column:
        mine = F.reverse(F.filter(at, lambda x: x["t"] == F.lit(entity)))

        def numbered(first: Column) -> Column:
            return F.transform(
                mine, lambda x, p: F.struct(x["i"].alias("i"), (first + p + F.lit(1)).alias("n"))
            )

        return let(start.cast("long"), numbered)

    parts = [ranked(entity, start) for entity, start in zip(entities, used)]
    none = F.array().cast("array<bigint>")
    return F.when(F.size(types) > 0, F.sort_array(F.concat(*parts)).getField("n")).otherwise(none)


def placeholders(types: Column, entities: Sequence[str], used: Sequence[Column]) -> Column:
    """Placeholders of a text's hits, in text order."""
    return F.zip_with(types, ranks(types, entities, used), placeholder)


def splice(pieces: Column, names: Column) -> Column:
    """Join the pieces around the hits with the placeholders between them."""

    def joined(p: Column) -> Column:
        heads = F.zip_with(F.slice(p, 1, F.size(names)), names, lambda g, n: F.concat(g, n))
        return F.concat(F.array_join(heads, ""), F.element_at(p, -1))

    return let(pieces, joined)


def entries(field: str, types: Column, names: Column, values: Column) -> Column:
    """Mapping entries of one text in visiting order (right to left)."""
    rows = F.transform(
        names,
        lambda n, i: F.struct(
            F.lit(field).alias("field"),
            F.get(types, i).alias("entity_type"),
            n.alias("placeholder"),
            F.get(values, i).alias("original"),
        ),
    )
    return F.reverse(rows).cast(f"array<{ENTRY}>")


def mapping(rows: Column) -> Column:
    """Entries as a map placeholder -> original, same order; never null."""
    pairs = F.transform(rows, lambda e: F.struct(e["placeholder"], e["original"]))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast(EMPTY_MAP))


def merge_mappings(first: Column, second: Column) -> Column:
    """Union of two mappings; an absent one counts as empty."""
    none = F.create_map().cast(EMPTY_MAP)
    return F.map_concat(F.coalesce(first, none), F.coalesce(second, none))
