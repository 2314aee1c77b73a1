"""Entity rules: one canonical pattern each, and its rendering for Spark.

The canonical text runs unchanged in any linear-time regex engine. Spark uses
the Java engine, which needs its own rendering for three reasons:

* ``\\b`` is not ASCII-only there, so it becomes explicit look-arounds;
* a repeated group recurses once per round and overflows the stack on a text
  with a very long dotted name, so repeats are possessive (they iterate);
* an e-mail attempt at every dot of a long run would be quadratic. So it is
  tried once, where a run of its characters begins: the separators there are
  taken along, as group ``BEFORE``, and the hit is the group ``HIT`` behind them.
  An e-mail starts at the first word character of its run, so no other start
  can be missed. ``\\G`` keeps the one exception, a run cut by the previous hit.

Both forms find the same hits; the tests compare them on random texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

_W = "[0-9A-Za-z_]"
_LOCAL = "[A-Za-z0-9._%+-]"
_ENDS = f"(?!{_W})"
_EDGE = f"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
_TLD = f"[A-Za-z]{{2,}}+{_ENDS}"
# A digit that starts a word; the cheap test comes first.
_FIRST_DIGIT = f"[0-9](?<!{_W}[0-9])"
# Where a hit of a rule other than e-mail can start.
_START = rf"(?:(?<!{_W})|(?=[+(])|\G)"

#: Groups of ``spark_pattern``: what stands before the hit and belongs to the text, and the hit.
BEFORE, HIT = 1, 4


@dataclass(frozen=True)
class Rule:
    """``hint``: cheap pattern in every text with a hit. ``tell``: only in hits of this rule."""

    name: str
    canonical: str
    spark: str
    hint: str
    tell: str


EMAIL = Rule(
    "EMAIL_ADDRESS",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b",
    rf"{_LOCAL}++@(?=[A-Za-z0-9-])"
    rf"(?:[A-Za-z0-9-]*+(?:\.(?!{_TLD})[A-Za-z0-9-]++)*+\.{_TLD})++",
    r"@",
    r"@",
)
SSN = Rule(
    "US_SSN",
    r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    rf"{_FIRST_DIGIT}[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}{_ENDS}",
    r"[0-9][ .-][0-9]{4}",
    r"^[0-9]{3}-[0-9]{2}-",
)
PHONE = Rule(
    "PHONE_NUMBER",
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b",
    r"(?=[+(0-9])(?:\+[0-9]{1,3}[ .-]?)?"
    rf"(?:\([0-9]{{3}}\)[ .-]?|{_FIRST_DIGIT}[0-9]{{2}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_ENDS}",
    r"[0-9][ .-][0-9]{4}",
    r"^(?:[+(]|[0-9]{3}[ .-][0-9]{3})",
)

# At equal starts the earlier rule wins; hits never overlap.
RULES: tuple[Rule, ...] = (EMAIL, SSN, PHONE)
ENTITIES: tuple[str, ...] = ("US_SSN", "PHONE_NUMBER", "EMAIL_ADDRESS")


def pick(entities: Sequence[str] | None) -> tuple[Rule, ...]:
    """Rules of the asked entity types, in priority order."""
    if entities is None:
        return RULES
    unknown = set(entities) - {r.name for r in RULES}
    if unknown or not entities:
        raise ValueError(f"unknown or no entity types: {sorted(unknown)}; known: {list(ENTITIES)}")
    return tuple(r for r in RULES if r.name in entities)


def canonical_pattern(rules: Sequence[Rule]) -> str:
    return "|".join(r.canonical for r in rules)


def spark_pattern(rules: Sequence[Rule]) -> str:
    """The Java rendering; a hit is its group ``HIT``, after the group ``BEFORE``."""
    others = [r.spark for r in rules if r is not EMAIL]
    if EMAIL not in rules:
        return f"{_START}()()()({'|'.join(others)})"
    # A number that starts with one of the separators comes first.
    plus = rf"(?!{PHONE.spark})\+" if PHONE in rules else r"\+"
    run = rf"(?<!{_LOCAL})((?:[.%-]|{plus})*+)()(?={_W})"
    # An empty group that is set tells that an e-mail may start here.
    email = rf"(?:\2|\3){EMAIL.spark}"
    start = f"|{_START}" if others else ""
    return rf"(?:{run}|\G{_EDGE}(){start})({'|'.join([email, *others])})"


def hints(rules: Sequence[Rule]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(r.hint for r in rules))


def token_pattern(entities: Sequence[str] = ENTITIES) -> str:
    """Anything that looks like a placeholder."""
    return f"(?:{'|'.join(entities)})_[0-9]{{4,}}"
