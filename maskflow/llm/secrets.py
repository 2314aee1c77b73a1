"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is named by the SHA-256 of its text. The ledger
has one row per blob and scan: which rules, in which version, have seen it,
and what they found. A scan takes only blobs that some current rule version
has not seen, each blob once however many paths and versions hold it, and
asks only the missing rules; findings are joined back to all paths.

Names are narrow rows; the texts are exchanged once, to meet the list of
blobs to scan. A common blob is no hot key there, as only the row that stands
for it matches.

Defined results: a null text is an empty one; repeated rows get the same
findings; texts of any length are scanned whole, in time linear in their
length; spans count code points, end exclusive; an empty history gives empty
results and an empty ledger.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from string import ascii_letters, ascii_lowercase, digits

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.llm.common import write_table


@dataclass(frozen=True)
class Rule:
    """A pattern for one kind of secret.

    A match counts if ``group`` of it has ``least`` characters or more. Only
    texts with one of ``hints`` (lower-cased if ``fold``) are searched. With
    ``head``, the match begins where ``head`` does, the leftmost that reaches
    ``pattern``'s match through characters of ``run``; so the search starts at
    the rarer middle, and a long run is passed once, not from each of its places.
    """

    kind: str
    version: int
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()
    fold: bool = False
    run: frozenset[str] = frozenset()
    head: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of all matches that count, leftmost first, none overlapping."""
        past = 0
        for m in re.compile(self.pattern, self.flags).finditer(text):
            if m.end(self.group) - m.start(self.group) < self.least:
                continue
            start, end = m.start(), m.end(self.group) if self.head else m.end()
            if self.head:
                low = start
                while low > past and text[low - 1] in self.run:
                    low -= 1
                head = re.compile(f"(?:{self.head})\\Z", self.flags).search(text[low:start])
                if start < past or not head:
                    continue
                start = low + head.start()
            past = end
            yield start, end


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: In the order in which kinds are listed at equal starts.
RULES = (
    Rule("assign", 1, _ASSIGN, re.ASCII | re.IGNORECASE, 2, 8, ("password", "passwd", "secret", "token", "apikey", "api_key"), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=16, hints=("AKIA",)),
    Rule("hex", 1, r"[0-9a-f]{32,}", least=32),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", hints=("PRIVATE KEY-----",)),
    # The second part and the signature are looked ahead at, as each part may turn out to be the first of a token.
    Rule(
        "jwt", 2, r"\.(?=(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+))", group=1, hints=("eyJ",), run=frozenset(ascii_letters + digits + "_-"),
        head=r"eyJ[A-Za-z0-9_-]{8,}",
    ),
    Rule("prefixed", 1, r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35})", hints=("gh", "xox", "AIza")),
    Rule("url", 2, r"://[^\s:/@]++:[^\s:/@]{3,}+@", hints=("://",), run=frozenset(ascii_lowercase + digits + "+.-"), head=r"[a-z][a-z0-9+.-]+"),
)

_HEX_DIGITS = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(".") for b in range(256))


def scan_text(text: str | None, rules: Sequence[Rule] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all hits, by start, then by the order of the rules."""
    text = text or ""
    low, found = None, []
    for order, rule in enumerate(rules):
        if rule.kind == "hex":
            # A run of 32 digits shows in one pass over the bytes.
            if b"h" * 32 not in text.encode("utf-8", "surrogatepass").translate(_HEX_DIGITS):
                continue
        elif rule.hints:
            if rule.fold and low is None:
                low = text.lower()
            if not any(h in (low if rule.fold else text) for h in rule.hints):
                continue
        found += [(start, order, rule.kind, end) for start, end in rule.spans(text)]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def pending(named: DataFrame, keys: Sequence[str], ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """(blob, first, missing): blobs that some rule version has not seen, and the row to read each from."""
    firsts = named.groupBy("blob").agg(F.min(F.struct(*keys)).alias("first"))
    current = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return firsts.withColumn("missing", current)
    seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    lacking = F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))
    return firsts.join(seen, "blob", "left").select("blob", "first", lacking.alias("missing")).filter(F.size("missing") > 0)


def scan_history(
    history: DataFrame, keys: Sequence[str], text_col: str = "text", ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES
) -> tuple[DataFrame, DataFrame]:
    """(findings, additions): spans of every row of ``history``, and the new ledger rows.

    ``findings`` has the keys, ``blob`` and ``spans``, sorted, of the current
    rule versions. ``additions`` is written to the shared folder; append it to
    the ledger that the next scan is given.
    """
    own = [f"k{i}" for i in range(len(keys))]
    rows = history.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(text_col).alias("text"))
    rows = rows.withColumn("blob", blob_name(F.col("text")))
    named = rows.drop("text")
    todo = pending(named, own, ledger, rules).select(F.col("blob").alias("_blob"), "first", "missing")
    match = F.col("blob") == F.col("_blob")
    for o in own:
        match &= F.col(o).eqNullSafe(F.col(f"first.{o}"))
    texts = rows.join(todo.hint("shuffle_hash"), match).select("blob", "text", "missing")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_name = {r.name: r for r in rules}
        for batch in batches:
            out = []
            for blob, text, missing in zip(batch["blob"], batch["text"], batch["missing"], strict=True):
                asked = [by_name[m] for m in missing]
                names = {r.kind: r.name for r in asked}
                spans = [{"rule": names[k], "start": s, "end": e} for k, s, e in scan_text(text, asked)]
                out.append((blob, [r.name for r in asked], spans))
            yield pd.DataFrame(out, columns=["blob", "rules", "spans"])

    additions, _ = write_table(texts.mapInPandas(scan, LEDGER), "ledger")
    known = additions if ledger is None else ledger.unionByName(additions)
    # Findings of rule versions that are no more are left out; those of rows read twice count once.
    current = F.array(*[F.lit(r.name) for r in rules])
    hits = known.select("blob", F.explode("spans").alias("s")).filter(F.array_contains(current, F.col("s.rule"))).distinct()
    place = F.struct(F.col("s.start"), F.array_position(current, F.col("s.rule")).alias("order"), F.col("s.rule"), F.col("s.end"))
    hits = hits.groupBy("blob").agg(F.sort_array(F.collect_list(place)).alias("spans"))
    kind = lambda s: F.split_part(s["rule"], F.lit("@"), F.lit(1)).alias("kind")
    plain = F.transform("spans", lambda s: F.struct(kind(s), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    found = named.join(hits.withColumn("spans", plain), "blob", "left").withColumn("spans", F.coalesce("spans", none))
    return found.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "blob", "spans"), additions


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")
