"""Packing by length combinations: repeat counts from non-negative least squares on the histogram of lengths.

Sequences are windows of ``tokens`` ids, a power of two; a window that is not
full is padded, except where it stops at a power of two. Documents are cut at
``tokens``, full pieces are sequences by themselves, and the loose piece that
is left of a document falls into a bin of lengths that differ by a thirtysecond
at most. All combinations of up to three bins that fill a window of 64, 128,
... ``tokens`` ids are columns of a non-negative least squares problem, whose
solution says how often each is best repeated to use up the histogram. Counts
are rounded down to what the bins hold, and the rest is packed greedily, bin
by bin, the longest first. Small windows lie side by side in large ones.

All this is on the histogram, so it costs the same for any table; which piece
goes where is then arithmetic on its number within its bin. No task packs
more than its own rows, and no bin, however hot, is brought together.

A share of the documents, chosen by hash, is kept back. The windows' gaps,
known to the id from the histogram, are filled with what these are cut into:
gaps and kept documents both lie along one line of ids, and where they overlap
is a piece. What is left of the line goes on after the windows, and its last
sequence is cut at powers of two. So nothing is padded, and only kept documents
and those longer than a window are cut.

Defined results: a null or empty text is its end id alone; rows with equal ids
are separate documents; equal lengths are placed by their rows; very long
texts are cut at ``tokens``; an empty table gives no pieces; other columns are
left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskflow.llm.common import write_table
from maskflow.llm.packing import encoder, in_slices

#: Bins per doubling of the length; shorter lengths have their own.
FINE = 32
#: Hash shares of the documents; as many as needed are kept back to fill gaps.
SHARES = 64
#: Ids of the line in which gaps and kept documents are compared together.
BLOCK = 1 << 16

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


# The histogram ------------------------------------------------------------------------


def bins(tokens: int) -> list[int]:
    """The greatest lengths of all bins, ascending."""
    out = list(range(1, min(2 * FINE, tokens) + 1))
    while out[-1] < tokens:
        unit = 2 * out[-1] // (2 * FINE)
        out += [out[-1] + unit * (i + 1) for i in range(FINE)]
    return out


def combinations(tokens: int) -> list[tuple[int, tuple[int, ...]]]:
    """(window, bins): up to three lengths, by number of their bin, that fill a window of a power of two."""
    tops = np.array(bins(tokens))
    out, window = [], tokens
    while window >= min(2 * FINE, tokens):
        near = window - window // FINE
        high = np.searchsorted(tops, window, side="right") - 1
        low = np.searchsorted(tops, window // 16)
        for a in range(high, low - 1, -1):
            if tops[a] > near:
                out.append((window, (a,)))
            b = np.searchsorted(tops, window - tops[a], side="right") - 1
            if low <= b <= a and tops[a] + tops[b] > near:
                out.append((window, (a, int(b))))
            for b in range(min(a, b), low - 1, -1):
                c = np.searchsorted(tops, window - tops[a] - tops[b], side="right") - 1
                if c > b:
                    break
                if low <= c and tops[a] + tops[b] + tops[c] > near:
                    out.append((window, (a, b, int(c))))
        window //= 2
    return out


def least_squares(columns: list[tuple[int, ...]], target: np.ndarray, weight: np.ndarray, steps: int = 4000) -> np.ndarray:
    """x >= 0 that makes sum((weight * (A x - target))^2) least; column j of A counts the rows named in ``columns[j]``.

    Active sets: the column that promises most joins those in use, and columns
    that turn negative leave, until none promises anything.
    """
    n, rows = len(columns), len(target)
    part = np.full((n, max(map(len, columns), default=1)), rows)
    for j, c in enumerate(columns):
        part[j, : len(c)] = c
    scaled = np.append(weight, 0.0)
    goal = weight * target
    x = np.zeros(n)
    used: list[int] = []
    dense = np.zeros((rows + 1, 0))
    tolerance = 1e-9 * max(1.0, float(goal @ goal)) ** 0.5

    def column(j: int) -> np.ndarray:
        out = np.zeros(rows + 1)
        np.add.at(out, part[j], scaled[part[j]])
        out[rows] = 0
        return out

    blocked = np.zeros(n, dtype=bool)
    for _ in range(steps):
        left = goal - dense[:rows] @ x[used]
        gain = (np.append(left, 0.0) * scaled)[part].sum(axis=1)
        gain[used] = -np.inf
        gain[blocked] = -np.inf
        best = int(np.argmax(gain)) if n else -1
        if best < 0 or gain[best] <= tolerance:
            break
        used.append(best)
        dense = np.hstack([dense, column(best)[:, None]])
        while used:
            a = dense[:rows]
            z = np.linalg.lstsq(a, goal, rcond=None)[0] if len(used) > rows else _solve(a, goal)
            if z.min() > 0:
                x[used] = z
                blocked[:] = False
                break
            now = x[used]
            down = z <= 0
            step = float(np.min(now[down] / np.maximum(now[down] - z[down], 1e-300)))
            if step == 0 and down[-1] and used[-1] == best and np.count_nonzero(down) == 1:
                blocked[best] = True  # promises more than rounding allows
            now = now + step * (z - now)
            stay = now > 1e-12 * max(1.0, float(now.max(initial=0)))
            x[used] = np.where(stay, now, 0.0)
            used = [j for j, s in zip(used, stay, strict=True) if s]
            dense = dense[:, stay]
    return x


def _solve(a: np.ndarray, goal: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a.T @ a, a.T @ goal)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, goal, rcond=None)[0]


def patterns(counts: np.ndarray, tokens: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(window, repeats, [(bin, how many in one window)]): every piece of the histogram is in one of them."""
    tops = bins(tokens)
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, int, list[tuple[int, int]]]] = []
    tries = [(w, c) for w, c in combinations(tokens) if all(left[b] for b in c)]
    x = least_squares([c for _, c in tries], counts.astype(float), np.array(tops, dtype=float))
    for j in np.argsort(-x * [w for w, _ in tries], kind="stable") if tries else ():
        window, names = tries[j]
        each = [(b, names.count(b)) for b in sorted(set(names), reverse=True)]
        times = min(int(x[j] + 0.5), *[int(left[b]) // m for b, m in each])
        if times:
            out.append((window, times, each))
            for b, m in each:
                left[b] -= times * m
    # What rounding and the bins leave over: the longest first, filled with the longest that still fit.
    while left.any():
        b = int(np.flatnonzero(left)[-1])
        window = 1 << max(min(2 * FINE, tokens) - 1, tops[b] - 1).bit_length()
        room, each, free = window, [], left.copy()
        while b >= 0:
            m = min(room // tops[b], int(free[b]))
            each.append((b, m))
            room -= m * tops[b]
            free[b] = 0
            fit = np.flatnonzero(free[: np.searchsorted(tops, room, side="right")])
            b = int(fit[-1]) if len(fit) else -1
        times = min(int(left[b]) // m for b, m in each)
        out.append((window, times, each))
        for b, m in each:
            left[b] -= times * m
    return sorted(out, key=lambda p: -p[0])


class Plan:
    """Where the pieces of each bin go, and how many hash shares of documents are kept back.

    ``counts`` and ``lengths`` (pieces, and their ids) are tables of bins and shares.
    """

    def __init__(self, counts: np.ndarray, lengths: np.ndarray, tokens: int):
        self.tokens, self.kept = tokens, 1
        while True:
            self.patterns = patterns(counts[:, self.kept :].sum(axis=1), tokens)
            self.windows = sum(w * n for w, n, _ in self.patterns)
            self.gaps = self.windows - int(lengths[:, self.kept :].sum())
            self.spare = int(lengths[:, : self.kept].sum())
            if self.spare >= self.gaps:
                break
            # As many shares as would do if gaps shrink with what is packed.
            open_ = self.gaps / int(lengths[:, self.kept :].sum())
            self.kept = min(SHARES, max(self.kept + 1, -int(-SHARES * open_ // (1 + open_))))
        #: Slots by bin: first number of a piece, pieces in a window, first window, its size, first slot in it.
        slots, at = [], 0
        taken = np.zeros(len(counts), np.int64)
        for window, times, each in self.patterns:
            slot = 0
            for b, m in each:
                slots.append((b, int(taken[b]), m, at, window, slot))
                taken[b] += times * m
                slot += m
            at += window * times
        self.slots = np.array(sorted(slots), dtype=np.int64).reshape(-1, 6)

    @property
    def end(self) -> int:
        """Where the line of sequences ends."""
        return self.windows + self.spare - self.gaps

    def place(self, bin_: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window's place, its size, slot) of pieces by their number in the bin."""
        span = int(self.slots[:, 1].max(initial=0)) + int(number.max(initial=0)) + 1
        keys = self.slots[:, 0].astype(float) * span + self.slots[:, 1]
        row = self.slots[np.searchsorted(keys, bin_.astype(float) * span + number, side="right") - 1]
        ahead = number - row[:, 1]
        return row[:, 3] + ahead // row[:, 2] * row[:, 4], row[:, 4], row[:, 5] + ahead % row[:, 2]

    def last_blocks(self) -> list[tuple[int, int]]:
        """(place, length) of the sequences that the last, shorter one is cut into, all powers of two."""
        at = self.end // self.tokens * self.tokens
        out = []
        for bit in range(self.tokens.bit_length() - 1, -1, -1):
            if (self.end - at) >> bit & 1:
                out.append((at, 1 << bit))
                at += 1 << bit
        return out


# Pieces --------------------------------------------------------------------------------

_PIECES = "share int, start long, length long, ids_crc32 long, doc_tokens long"


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, share): the share is a function of the row alone."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out.withColumn("share", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARES)).cast("int"))


def _tokenized(docs: DataFrame, path: str, tokens: int, end_id: int, loose_ids: bool) -> DataFrame:
    """The pieces of documents cut at ``tokens``; with ``loose_ids`` only the loose ones, with their ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for some in in_slices(batch, 1):
                ids, ends = encode.batch(some.column(1))
                which, rows, kept, at = [], [], [], 0
                for k, stop in enumerate(ends.tolist()):
                    whole = ids[at:stop].tobytes() + end
                    n = len(whole) // 4
                    for low in range(n // tokens * tokens if loose_ids else 0, n, tokens):
                        part = whole[4 * low : 4 * (low + tokens)]
                        which.append(k)
                        rows.append((low, len(part) // 4, zlib.crc32(part), n))
                        kept.append(part if loose_ids else None)
                    at = stop
                if not rows:
                    continue
                chosen = pa.array(which)
                made = [some.column(i).take(chosen) for i in (0, 2)] + [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                made += [pa.array(kept, pa.binary())] if loose_ids else []
                yield pa.RecordBatch.from_arrays(made, ["doc_id", *names])

    schema = _PIECES + (", ids binary" if loose_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.mapInArrow(cut, f"doc_id {kind}, {schema}")


def _binned(pieces: DataFrame, tokens: int) -> DataFrame:
    """``bin``: the number of the piece's bin among ``bins``."""
    bits = F.greatest(F.length(F.bin(F.col("length") - 1)) - FINE.bit_length(), F.lit(0))
    unit = pieces.withColumn("_bits", bits.cast("int"))
    # Up to 2 * FINE a bin for each length, then FINE bins to each doubling.
    number = F.expr(f"shiftrightunsigned(length - 1, _bits) + {FINE}L * _bits")
    return unit.withColumn("bin", number.cast("int")).drop("_bits")


def _with_totals(rows: DataFrame, size: str, name: str) -> DataFrame:
    """Rows, as a written table, with ``before``: the sum of ``size`` over all rows ahead of them.

    Ahead means earlier in the task, or in an earlier task: each task sums up
    its rows in one pass, and a row for each task carries the totals on.
    """
    columns = rows.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            sizes = batch.column(columns.index(size)).to_numpy(zero_copy_only=False)
            sums = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - sizes + done, pa.int64())], [*columns, "before"])
            done += int(sums[-1]) if len(sums) else 0

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    summed = rows.mapInArrow(add, f"{kinds}, before long").withColumn("part", F.spark_partition_id())
    summed, _ = write_table(summed, name)
    each = summed.groupBy("part").agg(F.sum(size).alias("sum"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select("part", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("carried"))
    return summed.join(F.broadcast(carried), "part").withColumn("before", F.col("before") + F.col("carried")).drop("part", "carried")


def _overlaps(gaps: DataFrame, kept: DataFrame) -> DataFrame:
    """(place, row, start, length): where gaps and kept documents overlap along the line.

    Both are cut at ``BLOCK``; within a block, what starts at or before a place last holds there.
    """

    def events(df: DataFrame, side: str, name: str) -> DataFrame:
        block = F.explode(F.sequence(F.expr(f"before div {BLOCK}"), F.expr(f"(before + size - 1) div {BLOCK}")))
        cut = df.select(F.col(name).alias("name"), "before", "size", block.alias("block"))
        start = F.greatest("before", F.col("block") * BLOCK)
        what = F.struct("name", (start - F.col("before")).alias("skip"), start.alias("start"))
        other = F.lit(None).cast("struct<name:long,skip:long,start:long>")
        both = {"gap": other, "doc": other} | {side: what}
        # Its end is a place, too: after the last one nothing holds.
        stop = F.least(F.col("before") + F.col("size"), (F.col("block") + 1) * BLOCK)
        begins = cut.select("block", start.alias("at"), *[c.alias(s) for s, c in both.items()])
        ends = cut.select("block", stop.alias("at"), *[other.alias(s) for s in both])
        return begins.unionByName(ends)

    every = events(gaps, "gap", "place").unionByName(events(kept, "doc", "row"))
    every = every.groupBy("block", "at").agg(F.max("gap").alias("gap"), F.max("doc").alias("doc"))
    up_to = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    after = F.lead("at").over(Window.partitionBy("block").orderBy("at"))
    held = every.select("at", after.alias("stop"), *[F.last(s, ignorenulls=True).over(up_to).alias(s) for s in ("gap", "doc")])
    inside = lambda s: F.col(f"{s}.skip") + F.col("at") - F.col(f"{s}.start")
    return held.filter("stop is not null and gap is not null and doc is not null").select(
        (F.col("gap.name") + inside("gap")).alias("place"),
        F.col("doc.name").alias("row"),
        inside("doc").alias("skip"),
        (F.col("stop") - F.col("at")).alias("length"),
    )


def pack_lengths(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 4096, end_id: int = 2
) -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if tokens < 1 or tokens & (tokens - 1):
        raise ValueError("tokens must be a power of two")
    spark = docs.sparkSession
    rows = _documents(docs, id_col, text_col)
    pieces = _tokenized(rows, path, tokens, end_id, loose_ids=False)
    pieces, _ = write_table(_binned(pieces, tokens).withColumn("row", F.monotonically_increasing_id()), "pieces")
    loose = pieces.filter(F.col("length") < tokens)

    # The histogram: bins times shares, whatever the table.
    seen = loose.groupBy("bin", "share").agg(F.count("*").alias("n"), F.sum("length").alias("sum")).collect()
    counts, lengths = (np.zeros((len(bins(tokens)), SHARES), np.int64) for _ in range(2))
    for r in seen:
        counts[r["bin"], r["share"]], lengths[r["bin"], r["share"]] = r["n"], r["sum"]
    plan = Plan(counts, lengths, tokens)

    # Numbers within the bin: those of the piece's input task, after those of earlier tasks.
    placed = loose.filter(F.col("share") >= plan.kept).withColumn("part", F.shiftright("row", 33))
    local = F.row_number().over(Window.partitionBy("bin", "part").orderBy("row")) - 1
    each = placed.groupBy("bin", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("bin", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    placed = placed.withColumn("number", local.cast("long")).join(each, ["bin", "part"])
    placed = placed.withColumn("number", F.col("number") + F.col("earlier")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "number"
    )

    def to_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = plan.place(*[batch.column(i).to_numpy(zero_copy_only=False) for i in (5, 6)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(c, pa.int64()) for c in made]], [*COLUMNS[:5], "window", "room", "slot"])

    kind = placed.schema["doc_id"].dataType.simpleString()
    parts = "start long, length long, ids_crc32 long, doc_tokens long"
    placed = placed.mapInArrow(to_windows, f"doc_id {kind}, {parts}, window long, room long, slot long")
    # A window holds its own size of pieces at most.
    ahead = F.sum("length").over(Window.partitionBy("window").orderBy("slot"))
    placed, _ = write_table(placed.withColumn("place", F.col("window") + ahead - F.col("length")), "placed")

    # Gaps of the windows, and the line after them, sequence by sequence.
    open_ = placed.groupBy("window").agg(F.max("room").alias("room"), F.sum("length").alias("used"))
    open_ = open_.select((F.col("window") + F.col("used")).alias("place"), (F.col("room") - F.col("used")).alias("size"))
    first, last = plan.windows // tokens, plan.end // tokens
    after = spark.range(first, max(first, last)).select(
        F.greatest(F.col("id") * tokens, F.lit(plan.windows)).alias("place"), ((F.col("id") + 1) * tokens).alias("stop")
    )
    tail = [(max(at, plan.windows), at + n) for at, n in plan.last_blocks() if at + n > plan.windows]
    after = after.unionByName(spark.createDataFrame(tail, "place long, stop long"))
    after = after.select("place", (F.col("stop") - F.col("place")).alias("size"))
    gaps = _with_totals(open_.unionByName(after).filter("size > 0"), "size", "gaps")

    kept = _tokenized(rows.filter(F.col("share") < plan.kept), path, tokens, end_id, loose_ids=True)
    kept, _ = write_table(kept.withColumn("row", F.monotonically_increasing_id()), "kept")
    line = _with_totals(kept.select("row", F.col("length").alias("size")), "size", "line")
    cuts = _overlaps(gaps, line).groupBy("row").agg(F.collect_list(F.struct("place", "skip", "length")).alias("cuts"))
    cut = kept.join(cuts, "row").select("doc_id", "start", "doc_tokens", F.explode("cuts").alias("c"), "ids")
    ids = F.substring("ids", (4 * F.col("c.skip") + 1).cast("int"), (4 * F.col("c.length")).cast("int"))
    filled = cut.select("doc_id", (F.col("start") + F.col("c.skip")).alias("start"), "c.length", F.crc32(ids).alias("ids_crc32"), "doc_tokens", "c.place")

    lined = placed.select(*COLUMNS[:5], "place").unionByName(filled)
    sequence, offset = F.expr(f"place div {tokens}"), F.col("place") % tokens
    for i, (at, _) in enumerate(plan.last_blocks()):
        sequence = F.when(F.col("place") >= at, F.lit(last + i)).otherwise(sequence)
        offset = F.when(F.col("place") >= at, F.col("place") - at).otherwise(offset)
    lined = lined.withColumn("sequence_id", sequence.cast("long")).withColumn("offset", offset.cast("long"))
    full = pieces.filter(F.col("length") == tokens).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return lined.select(*COLUMNS).unionByName(full.select(*COLUMNS))
