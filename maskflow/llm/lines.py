"""Line dedup: of equal and nearly equal lines over all documents the first stays.

Lines are compared in a normal form (trimmed, lower-cased). Equal lines are
folded by hash, from ``fold_chars`` code points on; nearly equal ones are looked
for from ``min_chars`` on. For these, a line is cut
into ``threshold + 1`` segments: within ``threshold`` edits of another line,
one segment stays whole and moves little (pigeonhole), so an index of (length,
segment number, segment text) is probed, for each length up to ``threshold``
below a line's own, with the few substrings whose places the edits before and
after allow. Lines that share one are candidates if two sketches of them allow
the threshold, too: an edit adds and takes away one letter at most, and breaks
one of sixteen pieces at most, while the others move little. Sketches are made
only of lines that share a segment. Candidates are verified on the lines' texts, common ends
stripped, by a banded edit distance whose band is one machine word: bit d of
word e is set if the diagonal d can be reached with e edits.

A line goes if an earlier line is within the threshold. "Earlier" is by
document id (null last), then text hash, then line number.

DataFrame functions only. Texts are never grouped: what is exchanged are
narrow rows of hashes, and the texts of candidate lines. The copies of lines
with more than one in ``HEAVY`` of all lines are left out of the index but for
the first; there are fewer than ``HEAVY`` such lines, so they are broadcast.

Defined results: a null text has no lines and stays null; lines shorter than
``fold_chars`` and lines of white space alone always stay; rows equal in id and text are edited alike, as one; an
empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions.detect import compute_once, let
from maskflow.llm.common import SPACE_CHARS, unused, write_table

#: A line with more than one in HEAVY of all lines is heavy.
HEAVY = 10_000
#: Letters whose counts are compared, and pieces of a line that are; any choice gives the same result.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz .,-01"
PIECES = 16


def _with_normal(lines: DataFrame) -> DataFrame:
    """``body`` added, the normal form of ``raw``, with no white space at its ends; made once per line."""
    # Taking off other white space than blanks costs more, so only where there is some.
    lines = compute_once(lines, {"_trimmed": F.trim("raw")})
    body = F.col("_trimmed")
    others = [test(body, F.lit(c)) for c in SPACE_CHARS[1:] for test in (F.startswith, F.endswith)]
    some = functools.reduce(Column.__or__, others)
    return compute_once(lines, {"body": F.lower(F.when(some, F.trim(body, F.lit(SPACE_CHARS))).otherwise(body))})


def _document(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def split_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, text_hash, line, hash, chars, body): the normal form of each line of ``min_chars`` or more, but white space.

    A line of white space alone has an empty normal form.
    """
    lines = F.posexplode(F.split("text", "\n", -1)).alias("line", "raw")
    out = _with_normal(docs.select("doc", "text_hash", lines)).select("doc", "text_hash", "line", "body")
    out = out.withColumn("chars", F.length("body")).filter(F.col("chars") >= max(min_chars, 1))
    return out.withColumn("hash", F.xxhash64("body"))


def _packed(numbers: list[Column]) -> Column:
    """Numbers of 0..255 as the bytes of longs, eight in each."""
    rows = [numbers[i : i + 8] for i in range(0, len(numbers), 8)]
    return F.array(*[functools.reduce(Column.bitwiseOR, [F.shiftleft(n.cast("long"), 8 * k) for k, n in enumerate(row)]) for row in rows])


def _letter_counts(body: Column) -> Column:
    """The counts of ``LETTERS``, up to 255 each, as bytes."""
    counts = [F.octet_length(body) - F.octet_length(F.replace(body, F.lit(c), F.lit(""))) for c in LETTERS]
    return _packed([F.least(n, F.lit(255)) for n in counts])


def _counts_allow(a: Column, b: Column, threshold: int) -> Column:
    part = lambda x, k: F.shiftrightunsigned(F.get(x, k // 8), 8 * (k % 8)).bitwiseAND(F.lit(255))
    more = [part(a, k) - part(b, k) for k in range(len(LETTERS))]
    added = functools.reduce(Column.__add__, [F.greatest(d, F.lit(0)) for d in more])
    taken = functools.reduce(Column.__add__, [F.greatest(-d, F.lit(0)) for d in more])
    return (added <= threshold) & (taken <= threshold)


def _pieces(body: Column, chars: Column, threshold: int) -> Column:
    """Per difference in length, the hash bytes of ``PIECES`` pieces, at each shift from -threshold on.

    The pieces are those of a line that many characters shorter, so that an
    untouched piece of it has the same byte here at the shift it moved by.
    """
    out = []
    for shorter in range(threshold + 1):
        size = F.floor((chars - shorter) / PIECES).cast("int")
        shifts = [
            _packed([F.xxhash64(F.substring(body, size * p + shift + 1, size)).bitwiseAND(F.lit(255)) for p in range(PIECES)])
            for shift in range(-threshold, threshold + 1)
        ]
        out.append(F.concat(*shifts))
    return F.array(*out)


def _pieces_allow(a: Column, b: Column, threshold: int) -> Column:
    """True if at most ``threshold`` pieces of the shorter line, a, are nowhere in b within that shift."""
    words, lost = PIECES // 8, F.lit(0)
    for w in range(words):
        own = F.get(a, threshold * words + w)
        missing = []
        for shift in range(2 * threshold + 1):
            # The lowest bit of a byte becomes the OR of its bits: set if the pieces differ.
            bits = own.bitwiseXOR(F.get(b, shift * words + w))
            for step in (4, 2, 1):
                bits = bits.bitwiseOR(F.shiftrightunsigned(bits, step))
            missing.append(bits)
        lost = lost + F.bit_count(functools.reduce(Column.bitwiseAND, missing).bitwiseAND(F.lit(0x0101010101010101)))
    return lost <= threshold


def _segment(chars: Column, i: int, parts: int) -> tuple[Column, Column]:
    """(start, length) of segment ``i`` of a line, from 1; the last ones take the rest."""
    base, rest = F.floor(chars / parts).cast("int"), F.pmod(chars, F.lit(parts)).cast("int")
    longer = F.greatest(F.lit(0), F.lit(i) - 1 - (F.lit(parts) - rest))
    return F.lit(1) + base * (i - 1) + longer, base + F.when(F.lit(i) > F.lit(parts) - rest, 1).otherwise(0)


def probes(threshold: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift) of each probe but those equal to an index entry.

    A segment can only have moved by as many places as edits before it and
    after it allow. Between lines of equal length one direction is enough.
    """
    out = []
    for shorter in range(threshold + 1):
        for i in range(1, threshold + 2):
            low = max(-(i - 1), shorter - (threshold + 1 - i))
            high = min(i - 1, shorter + (threshold + 1 - i))
            out += [(shorter, i, shift) for shift in range(low, high + 1) if shorter or shift > 0]
    return out


def _entries(lines: DataFrame, threshold: int, places: list[tuple[int, int, int]]) -> DataFrame:
    """(at, key, hash): the key of each of ``places`` in each line.

    Segment bounds are columns of their own: with all the arithmetic inside
    the array of keys, its generated method is too long for Java to compile.
    """
    bounds = {}
    for shorter in range(threshold + 1):
        bounds[f"_chars{shorter}"] = F.col("chars") - shorter
        for i in range(1, threshold + 2):
            start, length = _segment(F.col("chars") - shorter, i, threshold + 1)
            bounds |= {f"_start{shorter}_{i}": start, f"_length{shorter}_{i}": length}

    def key(shorter: int, i: int, shift: int) -> Column:
        piece = F.substring(F.col("body"), F.col(f"_start{shorter}_{i}") + shift, F.col(f"_length{shorter}_{i}"))
        return F.xxhash64(f"_chars{shorter}", F.lit(i), piece)

    return lines.withColumns(bounds).select(F.posexplode(F.array(*[key(*p) for p in places])).alias("at", "key"), "hash")


def shared_segments(lines: DataFrame, threshold: int) -> DataFrame:
    """(key, hash, shorter, indexed): entries and probes of the keys that different lines meet at.

    ``shorter``: by how much the line that the key looks for is shorter;
    ``indexed``: whether the line has the segment itself. Keys that only one
    line has, nearly all, end here: entries are dealt by key once, and both the
    sum over a key and the entries that it lets through read that exchange.
    """
    index = [(0, i, 0) for i in range(1, threshold + 2)]
    places = index + probes(threshold)
    each = _entries(lines, threshold, places)
    dealt = each.repartition("key")
    met = dealt.groupBy("key").agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.min("at").alias("first_at"))
    live = met.filter((F.col("low") != F.col("high")) & (F.col("first_at") < len(index))).select("key")
    # A key names the length looked for, so all places of a line with one key have the same ``shorter``.
    shorter = F.get(F.array(*[F.lit(p[0]) for p in places]), F.col("at")).alias("shorter")
    rows = dealt.join(live.hint("shuffle_hash"), "key").groupBy("key", "hash").agg(F.min("at").alias("at"))
    return rows.select("key", "hash", shorter, (F.col("at") < len(index)).alias("indexed"))


def candidates(shared: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b) hashes of lines, a < b, that share a segment where, and pieces and letters as, the threshold allows."""
    chars = F.length("body")
    sketches = texts.select("hash", _letter_counts(F.col("body")).alias("counts"), _pieces(F.col("body"), chars, threshold).alias("pieces"))
    known = shared.join(sketches, "hash").withColumn("pieces", F.get("pieces", F.col("shorter")))
    known, _ = write_table(known, "sketches")
    left = known.filter("indexed").select("key", F.col("hash").alias("a"), F.col("counts").alias("na"), F.col("pieces").alias("pa"))
    right = known.select("key", F.col("hash").alias("b"), F.col("counts").alias("nb"), F.col("pieces").alias("pb"))
    allowed = _pieces_allow(F.col("pa"), F.col("pb"), threshold) & _counts_allow(F.col("na"), F.col("nb"), threshold)
    pairs = left.join(right, "key").filter((F.col("a") != F.col("b")) & allowed)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _common_start(a: Column, b: Column, end: bool = False) -> Column:
    """Length of the common start (or end) of two strings, by halving."""
    piece = (lambda s, n: F.right(s, n)) if end else (lambda s, n: F.left(s, n))
    short = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def grow(known: Column, step: Column) -> Column:
        more = known + step
        return F.when((more <= short) & (piece(a, more) == piece(b, more)), more).otherwise(known)

    return F.aggregate(steps, F.lit(0), grow)


def _shift_left(col: Column, n: int, mask: int) -> Column:
    return F.shiftleft(col, n).bitwiseAND(F.lit(mask))


def within(a: Column, b: Column, threshold: int) -> Column:
    """True if the edit distance of two strings is at most ``threshold``.

    Walks along ``a``. The band holds the diagonals -threshold..threshold of
    the alignment table as bits; word e tells which of them e edits reach. For
    each character of ``a``, the bits of the diagonals on which ``b`` has the
    same character are made once, and all diagonals move at a time.
    """
    wide = 2 * threshold + 1
    mask = (1 << wide) - 1

    def spread_insertions(words: list[Column]) -> list[Column]:
        """Skipping a character of ``b`` leads to the next diagonal with one edit more."""
        out = [words[0]]
        for e in range(1, threshold + 1):
            out.append(words[e].bitwiseOR(_shift_left(out[e - 1], 1, mask)))
        return out

    def run(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]

        def step(state: Column, i: Column) -> Column:
            here = F.get(x, i)
            same = functools.reduce(
                Column.bitwiseOR,
                [
                    F.when(F.get(y, i + (d - threshold)) == here, F.lit(1 << d)).otherwise(F.lit(0))
                    for d in range(wide)
                ],
            )

            def move(m: Column) -> Column:
                old = [state[f"e{e}"] for e in range(threshold + 1)]
                new = [old[0].bitwiseAND(m)]
                for e in range(1, threshold + 1):
                    replaced, dropped = old[e - 1], F.shiftright(old[e - 1], 1)
                    new.append(old[e].bitwiseAND(m).bitwiseOR(replaced).bitwiseOR(dropped))
                return F.struct(*[w.alias(f"e{e}") for e, w in enumerate(spread_insertions(new))])

            return F.when(state[f"e{threshold}"] == 0, state).otherwise(let(same, move))

        first = spread_insertions([F.lit(1 << threshold)] * (threshold + 1))
        start = F.struct(*[w.alias(f"e{e}") for e, w in enumerate(first)])
        goal = F.call_function("shiftleft", F.lit(1), F.size(y) - F.size(x) + threshold)
        places = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1)).otherwise(F.array().cast("array<int>"))
        reached = F.aggregate(places, start, step, lambda s: s[f"e{threshold}"])
        return F.when(F.abs(F.size(y) - F.size(x)) > threshold, F.lit(False)).otherwise(reached.bitwiseAND(goal) != 0)

    def middle(p: Column) -> Column:
        inner = F.struct(p["a"].alias("a"), p["b"].alias("b"), _common_start(p["a"], p["b"]).alias("n"))

        def cut_start(q: Column) -> Column:
            rest = F.struct(F.substring(q["a"], q["n"] + 1, F.length(q["a"])).alias("a"), F.substring(q["b"], q["n"] + 1, F.length(q["b"])).alias("b"))

            def cut_end(r: Column) -> Column:
                tail = _common_start(r["a"], r["b"], end=True)

                def chars(s: Column, n: Column) -> Column:
                    body = F.left(s, F.length(s) - n)
                    return F.when(F.length(body) > 0, F.split(body, "")).otherwise(F.array().cast("array<string>"))

                return let(tail, lambda n: let(F.struct(chars(r["a"], n).alias("x"), chars(r["b"], n).alias("y")), run))

            return let(rest, cut_end)

        return let(inner, cut_start)

    return let(F.struct(a.alias("a"), b.alias("b")), middle)


def removed_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, min_chars: int = 40, fold_chars: int | None = None
) -> DataFrame:
    """(doc, text_hash, removed): numbers, from 0, of the lines that go, for documents that lose any.

    ``fold_chars``: equal lines go from this length on, ``min_chars`` if it is not given.
    """
    lines = split_lines(_document(docs, id_col, text_col), min_chars if fold_chars is None else min(fold_chars, min_chars))
    narrow, _ = write_table(lines.select("doc", "text_hash", "line", "hash"), "lines")
    place = F.struct(F.isnull("doc").alias("none"), "doc", "text_hash", "line")
    firsts, _ = write_table(narrow.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("copies")), "firsts")

    lines = lines.filter(F.col("chars") >= min_chars)
    # Copies of heavy lines beyond the first stay out of the index. At most HEAVY rows are broadcast.
    total = firsts.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    heavy = firsts.filter(F.col("copies") * HEAVY > total).select("hash", F.col("first").alias("own"))
    indexed = lines.join(F.broadcast(heavy), "hash", "left").filter(F.isnull("own") | (place == F.col("own"))).drop("own")
    shared, _ = write_table(shared_segments(indexed, threshold), "shared")
    needed, _ = write_table(shared.select("hash").distinct().join(firsts, "hash").select(F.col("hash").alias("_hash"), "first"), "needed")
    found = lines.join(needed.hint("shuffle_hash"), (F.col("hash") == F.col("_hash")) & (place == F.col("first")))
    texts, _ = write_table(found.select("hash", "first", "body").dropDuplicates(["hash"]), "candidates")
    pairs, _ = write_table(candidates(shared, texts, threshold), "pairs")

    side = lambda name: texts.select(F.col("hash").alias(name), F.col("first").alias(f"first_{name}"), F.col("body").alias(f"body_{name}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").filter(within(F.col("body_a"), F.col("body_b"), threshold))
    later = near.select(F.when(F.col("first_a") > F.col("first_b"), F.col("a")).otherwise(F.col("b")).alias("hash")).distinct()

    told = firsts.join(later.withColumn("near", F.lit(True)), "hash", "left").filter("copies > 1 OR near")
    # Copies of a heavy line meet a broadcast (at most HEAVY rows), not one another in a task.
    told, _ = write_table(told, "told")
    many = F.broadcast(told.filter(F.col("copies") * HEAVY > total))
    few = told.filter(F.col("copies") * HEAVY <= total)
    met = narrow.join(many, "hash").unionByName(narrow.join(many.select("hash"), "hash", "left_anti").join(few, "hash"))
    gone = met.filter(F.col("near") | (place != F.col("first")))
    # A set, as a repeated row has each of its lines once more.
    return gone.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, min_chars: int = 40, fold_chars: int | None = None
) -> DataFrame:
    """``docs`` without the lines that go, ``removed`` added: the numbers of the lines taken out.

    The texts are exchanged once, to meet the narrow list of their lines.
    """
    doc, its_hash, here, gone = unused(docs, "_doc", "_hash", "_here", "_gone")
    found = removed_lines(docs, id_col, text_col, threshold, min_chars, fold_chars).select(
        F.col("doc").alias(doc), F.col("text_hash").alias(its_hash), F.col("removed").alias(gone)
    )
    rows = docs.withColumn(here, F.xxhash64(text_col))
    met = rows.join(found.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(here) == F.col(its_hash)), "left")

    def kept(lines: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(numbers, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.isnull(gone), F.col(text_col)).otherwise(let(F.split(text_col, "\n", -1), kept))
    removed = F.coalesce(gone, F.array().cast("array<int>"))
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != "removed"]
    return met.select(*columns, removed.alias("removed"))
