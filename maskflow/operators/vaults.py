"""Restoring from a mapping that is held as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskflow.functions import patterns as P
from maskflow.functions.restore import unredact_tokens
from maskflow.operators.prefix import lookup


def unredact_with_vault(
    answers: DataFrame,
    vault: DataFrame,
    key: str,
    text: str,
    scope: Sequence[str],
    entities: Sequence[str] = P.ENTITIES,
    **spread,
) -> DataFrame:
    """Restore ``text`` of each answer from the long form vault.

    ``key`` is unique in ``answers``; ``scope`` names the columns that tie an
    answer to its vault rows (they may repeat, e.g. many answers to one
    request). Each answer asks once for each placeholder in it and gets its own
    small mapping back. Gives the columns of ``answers`` plus ``restored``.
    Answers without anything like a placeholder take no part in any shuffle.
    """
    pattern = P.token_pattern(entities)
    some = F.coalesce(F.col(text).rlike(pattern), F.lit(False))
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    asked = answers.filter(some).select(
        key, *[c for c in scope if c != key], F.explode(tokens).alias("placeholder")
    )
    known = vault.select(*scope, "placeholder", "original")
    found = lookup(asked, known, [*scope, "placeholder"], [key], **spread)
    pairs = F.collect_list(F.struct("placeholder", "original"))
    maps = (
        found.filter(F.col("original").isNotNull())
        .groupBy(key)
        .agg(F.map_from_entries(pairs).alias("_known"))
    )
    restored = unredact_tokens(F.col(text), F.col("_known"), entities)
    touched = answers.filter(some).join(maps, key, "left").withColumn("restored", restored).drop("_known")
    return touched.unionByName(answers.filter(~some).withColumn("restored", F.col(text)))
