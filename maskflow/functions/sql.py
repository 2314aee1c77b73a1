"""The column functions as temporary SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from maskflow.functions import patterns as P
from maskflow.functions.restore import HINT, KEY, TOKEN


def _unredact() -> str:
    """The rule of ``maskflow.functions.restore`` in SQL: whole tokens, found by binary search."""
    halves = ", ".join(str(1 << i) for i in range(30, -1, -1))
    name = "regexp_extract(k, r'^([A-Z_]*_)[0-9]{4,}$', 1)"
    prepared = f"""struct(
        sort_array(map_entries(m)) AS e,
        filter(array({halves}), s -> s <= size(map_keys(m))) AS steps,
        transform(sort_array(transform(filter(array_distinct(transform(map_keys(m), k -> {name})), n -> n <> ''),
            n -> struct(-length(n) AS less, n AS name))), s -> s.name) AS names)"""
    last = """aggregate(d.steps, 0, (p, s) -> IF(p + s <= size(d.e) AND get(d.e, p + s - 1).key <= k, p + s, p))"""
    found = f"""element_at(transform(array({last}), p -> IF(get(d.e, p - 1).key = k, get(d.e, p - 1), NULL)), 1)"""
    digits = "regexp_extract(w, '[0-9]+$', 0)"
    keys = f"transform(filter(d.names, n -> endswith(w, concat(n, {digits}))), n -> concat(n, {digits}))"
    entry = f"get(filter(transform({keys}, k -> {found}), x -> x IS NOT NULL), 0)"
    shown = f"""element_at(transform(array({entry}),
        x -> IF(x IS NULL, w, concat(left(w, length(w) - length(x.key)), x.value))), 1)"""
    odd = f"filter(map_entries(m), x -> NOT rlike(x.key, r'{KEY}'))"
    text = f"aggregate({odd}, t, (a, x) -> replace(a, x.key, x.value))"
    pieces = f"struct(split(u, r'{TOKEN}', -1) AS g, regexp_extract_all(u, r'({TOKEN})', 1) AS w, {prepared} AS d)"
    joined = f"""concat(array_join(zip_with(slice(s.g, 1, size(s.w)),
        element_at(transform(array(s.d), d -> transform(s.w, w -> {shown})), 1), (g, o) -> concat(g, o)), ''),
        element_at(s.g, -1))"""
    whole = f"element_at(transform(array({pieces}), s -> {joined}), 1)"
    return f"IF(m IS NULL, t, element_at(transform(array({text}), u -> IF(rlike(u, '{HINT}'), {whole}, u)), 1))"


def register(spark: SparkSession) -> list[str]:
    """Create has_pii, detect, redact and unredact; gives their names.

    ``detect(t)`` gives the hits as an array of structs, ``redact(t)`` masks a
    text by itself (numbers from 1, right to left), ``unredact(t, m)`` puts the
    originals of a mapping back.
    """
    pattern, hint = P.spark_pattern(P.RULES), "|".join(P.hints(P.RULES))
    kind = "".join(
        f" WHEN rlike(v, r'{r.tell}') THEN '{r.name}'" for r in P.RULES[:-1]
    )
    kind = f"CASE{kind} ELSE '{P.RULES[-1].name}' END"
    found = f"IF(rlike(t, r'{hint}'), regexp_extract_all(t, r'{pattern}', {P.HIT}), array())"
    # A split by the pattern would compile it for each row: the hits become marks, as in ``gaps``.
    mark, other, first = "concat(chr(1), chr(3))", "concat(chr(1), chr(2))", "chr(1)"
    marked = f"regexp_replace(replace(t, {first}, {other}), r'{pattern}', concat('${P.BEFORE}', {mark}))"
    pieces = f"""IF(rlike(t, r'{hint}'),
        transform(split({marked}, {mark}, -1), g -> replace(g, {other}, {first})), array(t))"""
    span = "ARRAY<STRUCT<entity_type: STRING, start: INT, end: INT, value: STRING, pos: INT>>"
    ends = """
        aggregate(
            zip_with(slice(s.g, 1, size(s.v)), s.v, (g, v) -> length(g) + length(v)),
            struct(0 AS at, CAST(array() AS ARRAY<INT>) AS ends),
            (a, x) -> struct(a.at + x AS at, concat(a.ends, array(a.at + x)) AS ends),
            a -> a.ends)"""
    placed = f"""
        element_at(transform(array({ends}), e -> transform(s.v, (v, i) -> struct(
            {kind}, get(e, i) - length(v), get(e, i), v, i))), 1)"""
    ranked = " , ".join(
        f"""transform(reverse(filter(s.h, x -> x.entity_type = '{e}')),
                (x, p) -> struct(x.pos AS i, format_string('{e}_%04d', p + 1) AS ph))"""
        for e in P.ENTITIES
    )
    bodies = {
        "has_pii(t STRING) RETURNS BOOLEAN": (
            f"coalesce(rlike(t, r'{hint}') AND rlike(t, r'{pattern}'), false)"
        ),
        f"detect(t STRING) RETURNS {span}": (
            f"element_at(transform(array(struct({found} AS v, {pieces} AS g)),"
            f" s -> CAST({placed} AS {span})), 1)"
        ),
        "redact(t STRING) RETURNS STRING": f"""
            element_at(transform(array(struct(detect(t) AS h, {pieces} AS g)),
              s -> IF(coalesce(size(s.h), 0) < 1, t,
                concat(array_join(zip_with(
                    slice(s.g, 1, size(s.h)), sort_array(concat({ranked})),
                    (g, r) -> concat(g, r.ph)), ''), element_at(s.g, -1)))), 1)""",
        "unredact(t STRING, m MAP<STRING, STRING>) RETURNS STRING": _unredact(),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]
