"""Mixing sources to target weights: a curriculum whose source weights change over training time.

Each source has a schedule: its weight at knots of the training time 0..1,
linear in between. The integral of a schedule is the source's share of all
words, capped at a number of passes over the source; what is above a cap goes
to the others by weight. The cumulative demand of a source is the integral up
to a time; inverted, it gives each copy of a document the time at which its
words are due, and documents are range-sorted by that time.

DataFrame functions only. Apart from one row per source, all is done in
narrow rows (id, source, size): a source of any size is split into 4,096
slices by a hash of the id, which is also the order of its documents.

Defined results: null texts count as size 0 and are taken 0 words; a null
source is a source of its own, last in order; rows with the same id are
separate documents; an empty table gives an empty plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.functions.detect import let

#: Hex digits of the order hash that name a slice of a source.
SLICE_DIGITS = 3

#: Schedules in turn for the sources by code point: (time, weight) knots.
#: Their integrals are 5, 2 and 1: heavy sources rise, light ones come early.
SCHEDULES = (
    ((0.0, 4.0), (1.0, 6.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 1.5), (1.0, 0.5)),
)


def _integrals(schedule: Sequence[tuple[float, float]]) -> list[float]:
    """The integral of a schedule up to each knot."""
    total = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        total.append(total[-1] + (t1 - t0) * (w0 + w1) / 2)
    return total


def targets(sizes: DataFrame, schedules=SCHEDULES, max_passes: int = 3) -> DataFrame:
    """(source, source_size, ...) to (…, weight, target): shares of all words, capped.

    With f(k) = (all - caps of the k first) / (weights of the others), sources
    by cap per weight, the level that fills all is the largest f: it rises as
    long as the next source is below the level and falls after.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    n = len(schedules)
    rank = F.pmod(F.row_number().over(in_order) - 1, F.lit(n))
    weights = F.array(*[F.lit(_integrals(s)[-1]) for s in schedules])
    every = Window.partitionBy()
    before = F.sum("_cap").over(by_cap) - F.col("_cap")
    rest = F.sum("weight").over(every) - F.sum("weight").over(by_cap) + F.col("weight")
    return (
        sizes.withColumn("schedule", rank.cast("int"))
        .withColumn("weight", F.get(weights, F.col("schedule")))
        .withColumn("_cap", F.col("source_size") * F.lit(max_passes))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_level", (F.sum("source_size").over(every) - before).cast("double") / rest)
        .withColumn("_level", F.max("_level").over(every))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_level")))
        .drop("_cap", "_ratio", "_level")
    )


def due_time(share: Column, schedule: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a source with this schedule has given ``share`` of its words."""
    out = F.lit(None).cast("double")
    for number, knots in enumerate(schedules):
        sums = _integrals(knots)
        want = share * F.lit(sums[-1])
        time = F.lit(1.0)
        for i in range(len(knots) - 2, -1, -1):
            (t0, w0), (t1, w1) = knots[i], knots[i + 1]
            slope = (w1 - w0) / (t1 - t0)
            over = want - F.lit(sums[i])
            # The root of w0 x + slope x^2 / 2 = over, in a form that suits slope 0.
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * over))
            part = F.lit(t0) + F.coalesce(F.try_divide(F.lit(2.0) * over, F.lit(w0) + root), F.lit(0.0))
            time = F.when(want <= F.lit(sums[i + 1]), part).otherwise(time) if i < len(knots) - 2 else part
        out = F.when(schedule == number, F.least(F.lit(1.0), time)).otherwise(out)
    return out


def plan_mix(
    docs: DataFrame, id_col: str, source_col: str, size: Column, schedules=SCHEDULES, max_passes: int = 3, whole: bool = False
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, positions.

    ``taken``: the words that the mix takes of the document, repeats counted.
    Full passes over the source come first; of the last pass, documents in
    the order of an id hash are taken until the target is met. The document at
    that border gives only its first words, or, with ``whole``, all or nothing,
    whichever is nearer. ``positions``: the training time of each copy.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), key.alias("_key")
    ).withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS))
    slices = sized.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    goal = targets(slices.groupBy("source").agg(F.sum("_sum").alias("source_size")), schedules, max_passes)
    same = lambda a, b, *names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    in_source = Window.partitionBy("source").orderBy("_slice")
    starts = slices.withColumn("_start", F.sum("_sum").over(in_source) - F.col("_sum")).drop("_sum")
    starts = (
        starts.alias("s")
        .join(goal.alias("g"), same("s", "g", "source"))
        .select("s.*", "g.source_size", "g.target", "g.schedule")
    )
    in_slice = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("_inner", F.coalesce(F.sum("size").over(in_slice), F.lit(0)))
        .alias("d")
        .join(starts.alias("s"), same("d", "s", "source", "_slice"))
        .select("d.doc_id", "d.source", "d.size", "s.source_size", "s.target", "s.schedule", (F.col("d._inner") + F.col("s._start")).alias("_at"))
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.round(F.col("target") - F.col("_passes") * F.col("source_size")).cast("long") - F.col("_at")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    if whole:
        extra = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0)).cast("long")
    copies = F.col("_passes").cast("int") + F.when(F.col("_extra") > 0, 1).otherwise(0)
    begin = lambda i: i * F.col("source_size") + F.col("_at")
    share = lambda i: F.least(F.lit(1.0), begin(i).cast("double") / F.col("target"))
    times = F.transform(F.sequence(F.lit(0), copies - 1), lambda i: F.round(due_time(share(i), F.col("schedule"), schedules), 9))
    none = F.array().cast("array<double>")
    return (
        placed.withColumn("_passes", passes)
        .withColumn("_extra", extra)
        .withColumn("taken", F.col("_passes") * F.col("size") + F.col("_extra"))
        .withColumn("positions", F.when((F.col("taken") > 0) & (copies > 0), times).otherwise(none))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "positions")
    )


def mix(docs: DataFrame, id_col: str, source_col: str, size: Column, **how) -> DataFrame:
    """The documents in training order: one row per copy, with ``position``, range-sorted by it.

    All columns of ``docs`` stay (``position`` is added, or replaced). The texts are joined
    to the narrow plan by id and source; ids that repeat are told apart by
    their size, and equal ones are interchangeable.
    """
    plan = plan_mix(docs, id_col, source_col, size, whole=True, **how).filter(F.size("positions") > 0)
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.cast("long").alias("_size"),
        F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("_order"), row.alias("_row"), F.lit(None).cast("array<double>").alias("_due"),
    )
    due = plan.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.xxhash64("positions").alias("_order"), F.lit(None).cast(given.schema["_row"].dataType).alias("_row"), F.col("positions").alias("_due"),
    )
    # One exchange of the texts: plan and documents meet in windows over the same key.
    same = ["_id", "_source", "_size"]
    nth = F.row_number().over(Window.partitionBy(*same, F.isnull("_due")).orderBy("_order"))
    met = given.union(due).withColumn("_nth", nth)
    met = met.withColumn("_at", F.max("_due").over(Window.partitionBy(*same, "_nth")))
    rows = met.filter(F.isnull("_due") & F.isnotnull("_at")).select("_row", F.explode("_at").alias("_due"))
    columns = [F.col(f"_row.`{c}`") for c in docs.columns if c != "position"]
    return rows.orderBy("_due").select(*columns, F.col("_due").alias("position"))
