"""Putting originals back: one rule for texts, chunks and streams.

A token is a run of capital letters and underscores with the digits that
follow, four at least, none left out. It is restored if it ends with a
placeholder of the mapping, all its digits included; the longest such
placeholder counts. So nothing is replaced inside a longer number, and nothing
that was put in is read again.

The entries of a mapping are sorted once per row, and each token finds its
entry by binary search: time grows with the text, and with the entries times
the logarithm of their number.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskflow.functions.detect import let

#: A token, as above. The run of letters is tried from its start only, so long runs cost their length.
TOKEN = "(?<![A-Z_])[A-Z_]++(?<=_)[0-9]{4,}+"
#: A cheap test that every text with a token passes.
HINT = "_[0-9]{4}"
#: A key that a token can end with.
KEY = "^[A-Z_]*_[0-9]{4,}$"

_DIGITS = "[0-9]+$"
#: Entries of which each is looked at.
FEW = 24
#: The two characters at a cut that splits a token; $ holds before a line break, too.
AT_CUT = "^[A-Z_0-9\\n\\r\\u0085\\u2028\\u2029][A-Z_0-9]"


def type_names(keys: Column, entities: Sequence[str] | None = None) -> Column:
    """What the placeholders among ``keys`` have before their digits, longest first."""
    names = F.array_distinct(F.transform(keys, lambda k: F.regexp_extract(k, "^([A-Z_]*_)[0-9]{4,}$", 1)))
    names = F.filter(names, lambda n: n != "")
    if entities is not None:
        names = F.filter(names, lambda n: n.isin(*[f"{e}_" for e in entities]))
    sized = F.transform(names, lambda n: F.struct((-F.length(n)).alias("less"), n.alias("name")))
    return F.transform(F.sort_array(sized), lambda s: s["name"])


def prepare(entries: Column, names: Column) -> Column:
    """(entries, names, steps) for ``resolve``, from an array of (key, value) in any order; make it once per row."""
    sizes = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])

    def whole(e: Column) -> Column:
        # The size is made once, not per step: a lambda makes all of its body anew each time.
        steps = F.when(F.size(e) > FEW, let(F.size(e), lambda n: F.filter(sizes, lambda s: s <= n)))
        return F.struct(e.alias("entries"), names.alias("names"), F.coalesce(steps, F.array().cast("array<int>")).alias("steps"))

    return let(F.sort_array(entries), whole)


def _find(known: Column, key: Column) -> Column:
    """The entry with this key, or null: of few entries by looking at each, else by a binary
    search that doubles back by halving steps, of which each costs as much as many looks."""
    entries = known["entries"]

    def step(at: Column, size: Column) -> Column:
        ahead = at + size
        fits = (ahead <= F.size(entries)) & (F.get(entries, ahead - F.lit(1))["key"] <= key)
        return F.when(fits, ahead).otherwise(at)

    last = F.aggregate(known["steps"], F.lit(0), step)
    searched = let(F.get(entries, last - F.lit(1)), lambda e: F.when(e["key"] == key, e))
    looked = F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))
    return F.when(F.size(entries) <= FEW, looked).otherwise(searched)


def _candidates(token: Column, names: Column) -> Column:
    """The placeholders that a token can end with, longest first."""

    def keys(digits: Column) -> Column:
        ends = F.filter(names, lambda n: F.endswith(token, F.concat(n, digits)))
        return F.transform(ends, lambda n: F.concat(n, digits))

    return let(F.regexp_extract(token, _DIGITS, 0), keys)


def _prefixes(run: Column, digits: Column, names: Column, least: Column, most: Column) -> Column:
    """(name, key): what a run of letters ends with, and that with ``least`` to ``most`` of the digits after it."""
    sizes = F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    ends = F.filter(names, lambda n: F.endswith(run, n))
    both = F.transform(
        ends, lambda n: F.transform(sizes, lambda k: F.struct(n.alias("name"), F.concat(n, F.left(digits, k)).alias("key")))
    )
    return F.flatten(both)


def asked_keys(token: Column, names: Column, longest: Column) -> Column:
    """The placeholders, of up to ``longest`` characters, that matter for a token: those that
    it ends with, and shorter numbers that a cut would make of it."""

    def keys(digits: Column) -> Column:
        run = F.left(token, F.length(token) - F.length(digits))
        found = _prefixes(run, digits, names, F.lit(4), F.least(F.length(digits), longest))
        return F.transform(found, lambda f: f["key"])

    return let(F.regexp_extract(token, _DIGITS, 0), keys)


def resolve(known: Column, token: Column) -> Column:
    """The entry (key, value) that a token ends with, or null."""
    found = F.transform(_candidates(token, known["names"]), lambda k: _find(known, k))
    return F.get(F.filter(found, lambda e: e.isNotNull()), F.lit(0))


def restore(text: Column, known: Column) -> Column:
    """``text`` with its tokens restored by what ``prepare`` made."""

    def whole(tokens: Column) -> Column:
        gaps = F.split(text, TOKEN, -1)

        def shown(token: Column, entry: Column) -> Column:
            head = F.left(token, F.length(token) - F.length(entry["key"]))
            return F.when(entry.isNull(), token).otherwise(F.concat(head, entry["value"]))

        out = F.transform(tokens, lambda t: let(resolve(known, t), lambda e: shown(t, e)))

        def joined(parts: Column) -> Column:
            heads = F.zip_with(F.slice(parts["gaps"], 1, F.size(tokens)), parts["out"], lambda g, o: F.concat(g, o))
            return F.concat(F.array_join(heads, ""), F.element_at(parts["gaps"], -1))

        return let(F.struct(gaps.alias("gaps"), out.alias("out")), joined)

    tokens = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    return F.when(text.rlike(HINT), let(tokens, whole)).otherwise(text)


def _pairs(mapping: Column) -> Column:
    return F.transform(F.map_entries(mapping), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def unredact(text: Column, mapping: Column) -> Column:
    """Put the originals of a mapping back.

    Keys that are no placeholders (no capital letters and four digits) are
    replaced wherever they occur, one after another.
    """
    odd = F.filter(_pairs(mapping), lambda e: ~e["key"].rlike(KEY))
    literal = F.aggregate(odd, text, lambda t, e: F.replace(t, e["key"], e["value"]))
    usual = F.when(F.exists(F.map_keys(mapping), lambda k: ~k.rlike(KEY)), literal).otherwise(text)
    return F.when(mapping.isNull(), text).otherwise(unredact_tokens(usual, mapping))


def unredact_tokens(text: Column, mapping: Column, entities: Sequence[str] | None = None) -> Column:
    """Put the originals of a mapping's placeholders back, those of the ``entities`` alone if given."""
    known = prepare(_pairs(mapping), type_names(F.map_keys(mapping), entities))
    restored = let(known, lambda k: restore(text, k))
    return F.when(mapping.isNotNull() & text.rlike(HINT), restored).otherwise(text)


def holdback_length(mapping: Column) -> Column:
    """Longest placeholder of the mapping; 0 without entries."""
    lengths = F.transform(F.map_keys(mapping), lambda k: F.length(k))
    return F.coalesce(F.array_max(lengths), F.lit(0))


def straddling(head: Column, tail: Column, known: Column) -> Column:
    """What a cut between ``head`` and ``tail`` would split; null if nothing.

    ``ahead``: characters before the cut of the placeholder that begins there.
    A shorter known number counts, too, if its digits go on behind it or the
    cut, as it would be misread; so all cuts in such a number move to one place.
    ``key``: the known placeholder that is split, if the whole token has one;
    ``rest``: characters of the token behind the cut.
    """

    def of(p: Column) -> Column:
        def found(s: Column) -> Column:
            # Digits before the cut; less than none if letters come after it.
            at = F.when(p["digits"] != "", F.length(p["digits"])).otherwise(-F.length(s["letters"]))
            digits = F.concat(p["digits"], s["digits"])
            run = F.concat(p["run"], s["letters"])

            def across(v: Column) -> Column:
                # Of all the digits the key has those up to the cut at least; just these only if more follow.
                least = F.greatest(F.lit(4), F.when(F.length(v["digits"]) > v["at"], v["at"]).otherwise(v["at"] + F.lit(1)))
                some = _prefixes(v["run"], v["digits"], known["names"], least, F.length(v["digits"]))
                some = F.filter(some, lambda f: (F.length(f["name"]) + v["at"] > 0) & _find(known, f["key"]).isNotNull())
                # The longest name is first.
                name = F.get(some, F.lit(0))["name"]
                rest = F.length(v["digits"]) - v["at"]
                whole = resolve(known, F.concat(v["run"], v["digits"]))["key"]
                split = (F.length(whole) > rest) & (rest > 0)
                out = F.struct((F.length(name) + v["at"]).alias("ahead"), F.when(split, whole).alias("key"), rest.alias("rest"))
                return F.when(name.isNotNull(), out)

            return let(F.struct(at.alias("at"), digits.alias("digits"), run.alias("run")), across)

        letters = F.when(p["digits"] == "", F.regexp_extract(tail, "^([A-Z_]*)[0-9]+", 1)).otherwise(F.lit(""))
        after = F.when(p["digits"] == "", F.regexp_extract(tail, "^[A-Z_]*([0-9]+)", 1)).otherwise(F.regexp_extract(tail, "^[0-9]+", 0))
        return let(F.struct(letters.alias("letters"), after.alias("digits")), lambda s: F.when(s["digits"] != "", found(s)))

    parts = F.struct(
        F.regexp_extract(head, "([A-Z_]+)[0-9]*$", 1).alias("run"), F.regexp_extract(head, "[A-Z_]([0-9]*)$", 1).alias("digits")
    )
    found = let(parts, lambda p: F.when(p["run"] != "", of(p)))
    return F.when(F.size(known["entries"]) > 0, found)


# The same rule in Python, for the rows of a stream.

_TOKEN = re.compile(TOKEN)
_HEAD = re.compile("([A-Z_]+)([0-9]*)$")


class Restorer:
    """The rule for one mapping, in plain Python; looks tokens up by hash."""

    def __init__(self, mapping: Mapping[str, str], names: Sequence[str] | None = None, hold: int | None = None):
        """``names`` and ``hold`` are those of the mapping; given, its keys are looked up alone, never listed."""
        self.mapping = mapping
        self.names, self.hold = self.facts(mapping) if names is None else (list(names), hold)

    @staticmethod
    def facts(mapping: Mapping[str, str]) -> tuple[list[str], int]:
        """What the placeholders have before their digits, longest first, and the length of the longest key."""
        names = {m[1] for m in (re.match("^([A-Z_]*_)[0-9]{4,}$", k) for k in mapping) if m}
        return sorted(names, key=len, reverse=True), max(map(len, mapping), default=0)

    def key(self, token: str) -> str | None:
        digits = token[len(token.rstrip("0123456789")) :]
        for name in self.names:
            if token.endswith(name + digits) and name + digits in self.mapping:
                return name + digits
        return None

    def restore(self, text: str) -> str:
        def shown(match: re.Match) -> str:
            key = self.key(match[0])
            return match[0] if key is None else match[0][: -len(key)] + self.mapping[key]

        return _TOKEN.sub(shown, text) if self.names and "_" in text else text

    def safe_length(self, text: str) -> int:
        """How many characters of ``text`` may go out while the longest placeholder is held back."""
        cut = max(0, len(text) - self.hold)
        # All names end with an underscore.
        if "_" not in text[max(0, cut - self.hold) : cut + self.hold]:
            return cut
        head = _HEAD.search(text, max(0, cut - self.hold), cut)
        if not cut or not head:
            return cut
        run, digits = head[1], head[2]
        after = text[cut : cut + self.hold]
        tail = re.match("()([0-9]+)" if digits else "([A-Z_]*)([0-9]+)", after)
        if not tail:
            return cut
        at = len(digits) or -len(tail[1])
        run, digits = run + tail[1], digits + tail[2]
        for name in self.names:
            if run.endswith(name) and len(name) + at > 0:
                sizes = range(max(4, at), min(len(digits), self.hold) + 1)
                if any(name + digits[:k] in self.mapping for k in sizes):
                    return cut - len(name) - at
        return cut
