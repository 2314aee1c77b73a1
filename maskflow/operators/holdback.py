"""Restoring answers that come in chunks: the batch form.

Let T be all chunks of a request joined, c_k its length after chunk k, and L
the longest placeholder of the request. After chunk k the text up to
``c_k - L`` is released, or up to the start of a placeholder that this would
split. The rest is released at the end. So each output depends only on the 2 L
characters before its chunk.

Chunks are dealt by request and fixed range of ``seq``, once. A request of any
length spreads over as many tasks as it has ranges; what a range needs to know
of the text before it comes from the last characters of the ranges before, one
narrow row each. The entries of a mapping are looked up by a join of the
placeholders in each range, so no range carries a mapping along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.functions.detect import let
from maskflow.functions.restore import (
    AT_CUT,
    HINT,
    TOKEN,
    asked_keys,
    holdback_length,
    prepare,
    restore,
    straddling,
    type_names,
    unredact,
)
from maskflow.operators.completion import nonempty_chunks

#: Values of ``seq`` in a range: few, as places in a text are counted from its start.
RANGE = 64
#: Ranges before one in which its 2 L characters are looked for; each has a character at least.
BEFORE = 1024

#: The error of an answer that broke off without a cause.
BROKEN = "answer broke off"

_ENTRIES = "array<struct<key:string,value:string>>"
_KEYS = ["request_id", "block"]


def _blocks(chunks: DataFrame) -> DataFrame:
    """(request_id, block, pieces): the chunks of each range of ``seq``, in order."""
    # Said here, as joins would else infer it for some readers, and the others could not share the exchange.
    named = nonempty_chunks(chunks).filter("request_id IS NOT NULL AND seq IS NOT NULL")
    rows = named.select(
        "request_id",
        F.floor(F.col("seq") / RANGE).alias("block"),
        F.struct(F.col("seq").cast("long").alias("seq"), "content").alias("piece"),
    )
    return rows.groupBy(*_KEYS).agg(F.sort_array(F.collect_list("piece")).alias("pieces"))


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["content"]), "")


def _texts(chunks: DataFrame, mappings: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """Ranges as text, preceded by what stands before them, with the entries of their placeholders.

    Columns: request_id, block, is_last, hold, base (characters before), text, pieces, known.
    ``broken`` (request_id): requests without a last range.
    """
    blocks = _blocks(chunks)
    facts = mappings.select(
        "request_id", holdback_length(F.col("mapping")).alias("hold"), type_names(F.map_keys("mapping")).alias("names")
    )
    # A scalar subquery: part of the same query, no job of its own.
    margin = (2 * F.coalesce(facts.agg(F.max("hold")).scalar(), F.lit(0))).cast("int")
    too_long = F.raise_error(F.lit(f"placeholders of more than {BEFORE // 2} characters")).cast("int")
    margin = F.when(margin > BEFORE, too_long).otherwise(margin)
    order = Window.partitionBy("request_id").orderBy("block")
    earlier = order.rowsBetween(-BEFORE, -1)
    ends = blocks.select(*_KEYS, F.right(_joined(F.col("pieces")), margin).alias("end"))
    around = ends.select(
        *_KEYS,
        F.array_join(F.collect_list("end").over(earlier), "").alias("before"),
        F.lead("block").over(order).isNull().alias("is_last"),
    ).join(facts, "request_id", "left")
    if broken is not None:
        cut_off = broken.select("request_id").distinct().withColumn("cut_off", F.lit(True))
        around = around.join(cut_off, "request_id", "left")
        around = around.withColumn("is_last", F.col("is_last") & F.isnull("cut_off")).drop("cut_off")
    around = around.withColumns(
        {
            "hold": F.coalesce("hold", F.lit(0)),
            "names": F.coalesce("names", F.array().cast("array<string>")),
            "before": F.right("before", (2 * F.coalesce("hold", F.lit(0))).cast("int")),
        }
    )
    texts = blocks.join(around, _KEYS).withColumns(
        {"base": F.length("before"), "text": F.concat("before", _joined(F.col("pieces")))}
    )

    tokens = F.array_distinct(F.regexp_extract_all("text", F.lit(f"({TOKEN})"), F.lit(1)))
    keys = F.array_distinct(F.flatten(F.transform(tokens, lambda t: asked_keys(t, F.col("names"), F.col("hold")))))
    asked = texts.filter((F.size("names") > 0) & F.col("text").rlike(HINT))
    asked = asked.select(*_KEYS, F.explode(keys).alias("key"))
    # A key cut short at either end of the text may be asked for, too; it is no token there.
    entries = mappings.select("request_id", F.explode("mapping").alias("key", "value"))
    found = asked.join(entries, ["request_id", "key"]).groupBy(*_KEYS)
    found = found.agg(F.collect_list(F.struct("key", "value")).alias("entries"))
    entries = F.coalesce("entries", F.array().cast(_ENTRIES))
    return texts.join(found, _KEYS, "left").select(
        *_KEYS, "is_last", "hold", "base", "text", "pieces", prepare(entries, F.col("names")).alias("known")
    )


def _ends() -> Column:
    """Where each piece ends in the text, after where the first one starts."""
    start = F.array(F.col("base"))
    return F.aggregate(
        "pieces", start, lambda all_, p: F.concat(all_, F.array(F.element_at(all_, -1) + F.length(p["content"])))
    )


def _split_by(at: Column) -> Column:
    """The known placeholder that a cut of the text at ``at`` splits, as of ``straddling``."""
    hold = F.col("hold")
    low = F.greatest(at - hold, F.lit(0))
    around = F.substring(F.col("text"), low + 1, at - low + hold)

    def split(w: Column) -> Column:
        inside = straddling(F.left(w, at - low), F.substring(w, at - low + 1, hold), F.col("known"))
        # Most cuts are in plain text, or at its limit.
        return F.when(F.contains(w, F.lit("_")) & F.substring(w, at - low, F.lit(2)).rlike(AT_CUT), inside)

    return let(around, split)


def _cuts() -> Column:
    """Up to where the text is released at the end of each piece, after where it was before."""

    def cut(end: Column) -> Column:
        def moved(at: Column) -> Column:
            return at - F.coalesce(_split_by(at)["ahead"], F.lit(0))

        return let(F.greatest(end - F.col("hold"), F.lit(0)), moved)

    plain = F.transform(_ends(), lambda end: F.greatest(end - F.col("hold"), F.lit(0)))
    return F.when(F.size("known.entries") == 0, plain).otherwise(F.transform(_ends(), cut))


def _released(texts: DataFrame, restored: bool) -> DataFrame:
    """request_id, block, seq and the released ``text`` (the rest: null ``seq``)."""

    def release(cuts: Column) -> Column:
        def one(seq: Column, low: Column, high: Column) -> Column:
            raw = F.substring(F.col("text"), low + 1, high - low)
            out = let(raw, lambda r: restore(r, F.col("known"))) if restored else raw
            return F.struct(seq.alias("seq"), out.alias("text"))

        said = F.transform("pieces", lambda p, i: one(p["seq"], F.get(cuts, i), F.get(cuts, i + F.lit(1))))
        rest = one(F.lit(None).cast("long"), F.element_at(cuts, -1), F.length("text"))
        kind = "array<struct<seq:long,text:string>>"
        tail = F.when(F.col("is_last"), F.array(rest)).otherwise(F.array().cast(kind))
        return F.concat(said.cast(kind), tail.cast(kind))

    rows = texts.select(*_KEYS, F.explode(let(_cuts(), release)).alias("s"))
    return rows.select(*_KEYS, "s.seq", "s.text")


def release_chunks(chunks: DataFrame, mappings: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """What each chunk releases, and what is left at the end.

    ``chunks``: request_id, seq (unique per request), content; ``mappings``:
    request_id (unique), mapping. Gives request_id, seq, content; a chunk that
    releases nothing has '', the rest of a request has a null ``seq``.

    ``broken``: request_id of the requests whose answer broke off after its
    last chunk. What was held back of it then is dropped.
    """
    released = _released(_texts(chunks, mappings, broken), restored=True)
    return released.select("request_id", "seq", F.col("text").alias("content"))


def full_answers(chunks: DataFrame, mappings: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """The whole answer of each request, as received and restored.

    Gives request_id, llm_response_redacted, final_response: one row per
    request that has a mapping or a chunk, of whatever length; a request
    without text has ''. Answers are put together from ranges, not chunk by chunk.

    With ``broken`` (request_id, error) there is a column ``error``, too. An
    answer that broke off has its error and no texts.
    """
    part = F.struct("block", _joined(F.col("pieces")).alias("text"))
    whole = _blocks(chunks).select("request_id", part.alias("part")).groupBy("request_id")
    whole = whole.agg(F.sort_array(F.collect_list("part")).alias("parts"))
    whole = whole.select("request_id", F.array_join("parts.text", "").alias("raw"))
    asked = chunks.select("request_id").distinct()
    asked = asked.join(mappings.select("request_id", "mapping"), "request_id", "full")
    raw, ok, error = F.coalesce("raw", F.lit("")), F.lit(True), []
    if broken is not None:
        causes = broken.select("request_id", F.coalesce("error", F.lit(BROKEN)).alias("error"))
        asked, ok, error = asked.join(causes, "request_id", "full"), F.isnull("error"), ["error"]
    return asked.join(whole, "request_id", "left").select(
        "request_id",
        F.when(ok, raw).alias("llm_response_redacted"),
        F.when(ok, unredact(raw, F.col("mapping"))).alias("final_response"),
        *error,
    )


def _held(chunks: DataFrame, released: DataFrame) -> DataFrame:
    last = chunks.groupBy("request_id").agg((F.max("seq") + 1).cast("long").alias("_after"))
    rest = released.filter(F.col("seq").isNull()).join(last, "request_id")
    rest = rest.select("request_id", F.col("_after").alias("seq"), F.col("text").alias("content"))
    pieces = released.filter(F.col("seq").isNotNull())
    return pieces.select("request_id", "seq", F.col("text").alias("content")).unionByName(rest)


def released_pieces(chunks: DataFrame, mappings: DataFrame) -> DataFrame:
    """The released pieces before restoring, as chunks again (rest: last seq + 1)."""
    return _held(chunks, _released(_texts(chunks, mappings), restored=False))


def split_placeholders(chunks: DataFrame, mappings: DataFrame) -> DataFrame:
    """Known placeholders that the limit before a chunk cuts in two.

    An occurrence is reported at the chunk in which it ends.
    """
    return splits(chunks, mappings).filter("NOT held").drop("held")


def splits(chunks: DataFrame, mappings: DataFrame) -> DataFrame:
    """(request_id, seq, placeholder, held): what the limits before chunks split, as they
    come (``held`` false) and as they are released (true: nothing, or the rule is broken).

    Both are read off the same ranges: the places of the chunks, and of the cuts.
    """

    def at(limits: Column, held: bool) -> Column:
        """Placeholders split by the limit before each piece, if they end in it."""

        def one(p: Column, i: Column) -> Column:
            low, high = F.get(limits, i), F.get(limits, i + F.lit(1))

            def whole(s: Column) -> Column:
                return F.when(low + s["rest"] <= high, s["key"])

            cut = F.when(low > 0, _split_by(low))
            return F.struct(p["seq"].alias("seq"), let(cut, whole).alias("placeholder"), F.lit(held).alias("held"))

        return F.transform("pieces", one)

    texts = _texts(chunks, mappings).filter(F.size("known.entries") > 0)
    both = F.concat(let(_ends(), lambda e: at(e, False)), let(_cuts(), lambda c: at(c, True)))
    rows = texts.select("request_id", F.explode(both).alias("s")).select("request_id", "s.*")
    return rows.filter("placeholder IS NOT NULL").select("request_id", "seq", "placeholder", "held")
