"""Main text of web pages: markup roles, and substrings that the pages of a host repeat.

A page is parsed into blocks of text in page order. Blocks in an article (or
main) element are the main text. Blocks that the markup names as something
else (menus, headers, footers, sidebars, adverts, forms, notices, comments) are
not. All others are open, and are the main text of pages without an article.

Markup does not tell all. A substring of ``RUN`` tokens or more is boilerplate if
it stands in ``BODIES`` distinct bodies of a host at least, and in ``SHARE`` of
its bodies; a body is all text of a page but the named blocks, so copies of
a page, whatever their urls and menus, count once. Such substrings are found
in the sorted suffixes of a host's blocks: where neighbours have ``RUN`` tokens
in common, they are of one repeat (``repeats``). Each longer repeat is the
union of its parts of ``RUN`` tokens, each in as many bodies at least, so what
is covered is what the maximal repeats cover. Of open blocks the covered tokens
go. Of an article those blocks go that are covered whole and begin as blocks
of as many bodies do (share lines, notices without a telling class); if they were
more than half of its words, it is a copy with changes, and nothing goes.
Never cut are headings, shorter blocks and pages without a host.

Only suffixes that can matter are sorted: the runs of open blocks, and those
that begin blocks of articles, are hashed and counted first, by run and body before by
run, and blocks without a frequent one take no further part. Suffixes are sorted by
range, with the page as salt, so a host, or a menu, with a third of all pages is no hot
group; repeats that go over a limit of two ranges are put together by one row
per range. A page's html stays where it is but for joins with blocks that have
frequent runs and with repeated places.

Defined results: null or empty html gives empty text; a null or odd url
belongs to no host; equal rows count as one page and have equal results;
unclosed elements end with the element around them, tags, comments and scripts
without an end with the page; text outside any element is an open block; pages
of any length are parsed whole, in time linear in their length; a column
``main_text`` is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.llm.common import unused, write_table

#: Tokens of a run; shorter blocks are never cut.
RUN = 6
#: Tokens by which suffixes are sorted.
DEPTH = 2 * RUN
#: Distinct bodies of a host that a repeated run stands in, at least, and share of its bodies.
BODIES, SHARE = 3, 0.5

_TAG = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>=`]+)))?""")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORDS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")

#: Elements whose content is no text of the page, to the end of the page if they are not closed ...
_RAW = frozenset("script style title textarea iframe".split())
#: ... or passed over as tags only if they are not closed.
_SKIPPED = frozenset("noscript template svg select math object".split())
#: Elements that end a block.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul button label".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose nesting is followed.
_NESTED = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form head header main menu nav ol section span "
    "table tbody td tfoot th thead tr ul button p a".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are not main text by their name.
_OTHER = frozenset("nav footer aside form head menu button dialog header".split())
#: Classes, ids and roles that say the same.
_OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar widget nav navbar "
    "navigation menu breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent notice notices alert popup modal "
    "overlay comment comments disqus replies reply share sharing social related recommended newsletter subscribe signup login "
    "search pagination pager toolbar skip complementary contentinfo dialog alertdialog form".split()
)
#: Words that may stand beside them in a name: cookie-notice, site-footer, share_buttons; but not search-results, form-factor.
_LAYOUT = frozenset(
    "site main top bottom left right primary secondary global page box block wrapper wrap container inner outer list links link bar "
    "button buttons icon icons item items section area panel slot unit module posts articles stories sticky mobile desktop".split()
)
#: Names that hold for an article inside, too, and for an article itself.
_COMMENTS = frozenset("comment comments disqus reply replies".split())
_APART = _COMMENTS | frozenset("sidebar related recommended footer complementary contentinfo dialog alertdialog".split())


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name, the first of a name; '' without a value."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _names(found: dict[str, str], ids: bool) -> set[str]:
    """Which of ``_OTHER_NAMES`` the class, role or id say; a name counts whole, all its words have to be known."""
    said = set()
    for name in (found.get("class", "") + " " + found.get("role", "") + " " + (found.get("id", "") if ids else "")).split():
        words = [w.lower() for w in _WORDS.split(name if not name.isupper() else name.lower()) if w and not w.isdigit()]
        if all(w in _OTHER_NAMES or w in _LAYOUT for w in words):
            said.update(w for w in words if w in _OTHER_NAMES)
    return said


def _other(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no main text, and whether that holds for articles inside it."""
    by_tag = tag in _OTHER and not (tag == "header" and in_article)
    apart = tag in ("aside", "footer", "dialog")
    if not attrs or attrs.isspace():
        return by_tag, apart
    found = _attributes(attrs)
    if found.get("hidden", "until-found").lower() not in ("until-found", "false") or _UNSHOWN.search(found.get("style", "")):
        return True, True
    # Sections of an article have ids that authors chose for their content.
    said = _names(found, ids=True)
    if in_article and tag == "section" and not said & _COMMENTS:
        said = _names(found, ids=False)
    if in_article:
        said.discard("header")
    if tag in ("html", "body"):
        said = set()
    elif tag in ("article", "main") and not in_article:
        said &= _COMMENTS
    return by_tag or bool(said), apart or not said.isdisjoint(_APART)


def _end_of_tag(html: str, at: int, quotes: bool) -> int:
    """Where the > of the tag around ``at`` stands, -1 if nowhere; a value in quotes holds any character."""
    while True:
        m = _STOP.search(html, at)
        if not m:
            return -1
        if m[0] == ">":
            return m.start()
        at = m.end()
        if quotes and html[m.start() - 1] in "= \t\n\r\f":
            close = html.find(m[0], at)
            if close < 0:
                return -1
            at = close + 1


def _tags(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before, tag in lower case, whether it closes, attributes) in page order, the last without a tag.

    Each character is passed a bounded number of times. Tags, comments and
    declarations without an end reach to the end of the page. A quote without
    its end is none, and then no later quote of the page is one.
    """
    at = start = 0
    quotes, unclosed = True, set()
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            yield html[start:at], "", False, ""
            if end < 0:
                return
            at = start = end + 3
            continue
        m = _TAG.match(html, at + 1)
        if not m:
            if html[at + 1 : at + 2] not in ("!", "?", "/"):
                at += 1
                continue
            end = html.find(">", at)
            yield html[start:at], "", False, ""
            if end < 0:
                return
            at = start = end + 1
            continue
        end = _end_of_tag(html, m.end(), quotes)
        if end < 0 and quotes:
            quotes = False
            end = html.find(">", m.end())
        if end < 0:
            yield html[start:at], "", False, ""
            return
        tag, closes, attrs = m[1].lower(), html[at + 1] == "/", html[m.end() : end]
        if not closes and tag in (_RAW | _SKIPPED) - unclosed and not (attrs.endswith("/") and tag in _SKIPPED):
            last = re.compile(f"</{tag}(?![a-z0-9:-])[^>]*>", re.I).search(html, end + 1)
            if last or tag in _RAW:
                yield html[start:at], "", False, ""
                if not last:
                    return
                at = start = last.end()
                continue
            unclosed.add(tag)
        yield html[start:at], tag, closes, attrs
        at = start = end + 1
    yield html[start:], "", False, ""


def blocks_of(html: str | None) -> list[tuple[str, str]]:
    """(kind, text) of a page's blocks in order; kind: main, other, open or, of headings, title (of articles) or head."""
    out: list[tuple[str, str]] = []
    parts: list[str] = []
    # Of each open element its tag and, with all around it: other, apart, in an article, muted; and blocks opened in it.
    stack: list[list] = [["", False, False, False, False, 0]]
    places: dict[str, list[int]] = {}
    kind, heading = "open", False

    def end_block() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(({"open": "head", "main": "title"}.get(kind, kind) if heading else kind, text))

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop()[0]].pop()

    for text, tag, closes, attrs in _tags(html or ""):
        if text and not stack[-1][4]:
            parts.append(text)
        if not tag:
            continue
        if tag in _BLOCKS:
            end_block()
            heading = not closes and tag in _HEADINGS
            if not closes and stack[-1][0] == "p":
                close_to(len(stack) - 1)
        elif tag == "br":
            parts.append(" ")
        if tag in _BLOCKS and tag not in _NESTED or tag == "p":
            # An element in the line ends with the block around it.
            if not closes:
                stack[-1][5] += 1
            elif stack[-1][5]:
                stack[-1][5] -= 1
            elif stack[-1][4]:
                close_to(len(stack) - 1)
        if tag not in _VOID and tag in _NESTED:
            top = stack[-1]
            if closes:
                held = places.get(tag)
                bar = max((places[b][-1] for b in ("article", "main", "body") if b != tag and places.get(b)), default=0)
                if held and (held[-1] > bar or tag == "body"):
                    close_to(held[-1])
            else:
                other, apart = _other(tag, attrs, top[3])
                inline = tag in ("a", "span")
                if other or tag not in ("p", "a", "span"):
                    places.setdefault(tag, []).append(len(stack))
                    if tag in ("article", "main") and not top[3] and not top[2] and not other:
                        # What was left open before the article ends here.
                        stack.append([tag, False, False, True, False, 0])
                    else:
                        article = top[3] or (tag in ("article", "main") and not other and not top[1])
                        muted = top[4] or (inline and other)
                        stack.append([tag, top[1] or (other and not inline), top[2] or apart, article, muted, 0])
        now = "other" if stack[-1][1] else "main" if stack[-1][3] else "open"
        if now != kind:
            end_block()
            kind = now
    end_block()
    return out


def host_of(url: Column) -> Column:
    """Lower-cased host of a url, '' if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def heads(text: str, run: int = RUN, most: int | None = None, depth: int | None = None) -> list[tuple[int, str]]:
    """(token number, its first ``depth`` tokens) of the suffixes of a block, of ``run`` tokens or more; the first ``most``."""
    words = text.split(" ")
    count = max(0, len(words) - run + 1)
    return [(i, " ".join(words[i : i + (depth or run)])) for i in range(count if most is None else min(most, count))]


def uncovered(text: str, starts: list[int], run: int = RUN) -> str:
    """What repeated substrings that begin at the tokens ``starts`` leave of a block."""
    words = text.split(" ")
    cover = np.zeros(len(words), dtype=bool)
    for i in starts:
        cover[i : i + run] = True
    return " ".join(w for w, c in zip(words, cover, strict=True) if not c)


def _has_article(blocks: list[tuple[str, str]]) -> bool:
    return any(kind in ("main", "title") for kind, _ in blocks)


def _of_article(blocks: list[tuple[str, str]], repeated: dict[int, list[int]]) -> Iterator[str]:
    """The blocks of an article but those that repeats cover whole, unless these are more than half of it."""
    own = [(n, kind, text) for n, (kind, text) in enumerate(blocks) if kind in ("main", "title")]
    covered = {n for n, kind, text in own if kind == "main" and n in repeated and not uncovered(text, repeated[n])}
    words = {n: text.count(" ") + 1 for n, _, text in own}
    if 2 * sum(words[n] for n in covered) > sum(words.values()):
        covered = set()
    return (text for n, _, text in own if n not in covered)


def main_text(html: str | None, repeated: dict[int, list[int]] | None = None) -> str:
    """The main text, given the repeated places (block number to token numbers) of open blocks and of an article's."""
    found, repeated = blocks_of(html), repeated or {}
    if _has_article(found):
        return "\n".join(_of_article(found, repeated))
    kept = []
    for number, (kind, text) in enumerate(found):
        if kind == "open":
            kept.append(uncovered(text, repeated.get(number, [])))
        elif kind == "head":
            kept.append(text)
    return "\n".join(t for t in kept if t)


def _body(blocks: list[tuple[str, str]]) -> int:
    """A number of the page's body: all of its text but the named blocks."""
    own = "\n".join(text for kind, text in blocks if kind != "other")
    return int.from_bytes(hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def common_tokens(a: str, b: str) -> int:
    """With how many equal tokens two suffixes begin."""
    n = 0
    for x, y in zip(a.split(" "), b.split(" "), strict=False):
        if x != y:
            break
        n += 1
    return n


def repeats(suffixes: DataFrame, run: int = RUN) -> DataFrame:
    """``suffixes`` (host, head and others) with ``repeat``: the same for all that are neighbours by ``run`` tokens.

    Suffixes are sorted by range of host, head and, as salt, all else, and each
    is compared with the one before it. Repeats are numbered within a range;
    one that goes on from the range before has the number it had there.
    """
    names = suffixes.columns

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, before = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            numbers, edge = [], [False] * len(batch)
            if before is None:
                edge[:1] = [True] * len(edge[:1])
            for now in zip(batch["host"], batch["head"], strict=True):
                if before is None or before[0] != now[0] or before[1] != now[1] and common_tokens(before[1], now[1]) < run:
                    number += 1
                numbers.append(number)
                before = now
            yield batch.assign(part=part, number=numbers, edge=edge)
            # The last of each batch, too, as none knows whether it is the last of the range.
            if edge:
                yield batch.iloc[-1:].assign(part=part, number=number, edge=None)

    order = [F.col(c) for c in ("host", "head", *[c for c in names if c not in ("host", "head")])]
    dealt = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in suffixes.dtypes) + ", part int, number int, edge boolean"
    rows, _ = write_table(dealt.mapInPandas(neighbours, schema), "suffixes")
    # One row per range and end: the limits between ranges.
    ends = rows.filter("edge OR edge IS NULL").groupBy("part").agg(
        F.min_by(F.struct("host", "head"), F.when(F.col("edge"), 0)).alias("first"),
        F.max_by(F.struct("host", "head", "number"), F.when(F.isnull("edge"), F.struct("number", "host", "head"))).alias("last"),
    )
    moved, last = [], None
    for end in sorted(ends.collect(), key=lambda r: r["part"]):
        first, of = end["first"], (end["part"], 0)
        if last and last[0] == first["host"] and common_tokens(last[1], first["head"]) >= run:
            of = last[2]
            moved.append((end["part"], 0, *of))
        number = end["last"]["number"]
        last = end["last"]["host"], end["last"]["head"], of if number == 0 else (end["part"], number)
    moves = suffixes.sparkSession.createDataFrame(moved, "part int, number int, to_part int, to_number int")
    met = rows.filter("edge IS NOT NULL").join(F.broadcast(moves), ["part", "number"], "left")
    repeat = F.struct(F.coalesce("to_part", "part").alias("part"), F.coalesce("to_number", "number").alias("number"))
    return met.select(*names, repeat.alias("repeat"))


def repeated_places(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(key, places) of pages (key, host, html): repeated (block, token) places of their open blocks and of articles' blocks."""

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, host, html in zip(batch["key"], batch["host"], batch["html"], strict=True):
                found = blocks_of(html)
                body, article = _body(found), _has_article(found)
                rows.append((host, None, key, body, -1, False))
                for number, (kind, text) in enumerate(found):
                    if kind == "open":
                        rows += [(host, head, key, body, number, not article) for _, head in heads(text, run)]
                    elif kind == "main":
                        rows += [(host, head, key, body, number, True) for _, head in heads(text, run, 1)]
            yield pd.DataFrame(rows, columns=["host", "head", "key", "body", "block", "cut"])

    # Each page gives one more row, without a run: the bodies that have it are all of the host.
    named = pages.filter("host <> ''")
    found = named.mapInPandas(seeds, "host string, head string, key long, body long, block int, cut boolean")
    hashes = F.xxhash64("host", "head").alias("a"), F.xxhash64("head", F.lit(1), "host").alias("b")
    # Written, as it is read three times and pages are costly to parse.
    found, _ = write_table(
        found.select(F.xxhash64("host").alias("host"), F.isnull("head").alias("page"), *hashes, "key", "body", "block", "cut"), "runs"
    )
    met = found.groupBy("host", "page", "a", "b").agg(F.count_distinct("body").alias("n"), F.max("cut").alias("cut"))
    hosts = met.filter("page").select("host", F.greatest(F.lit(BODIES), F.ceil(SHARE * F.col("n"))).alias("least"))
    often = met.filter("NOT page AND cut").join(hosts, "host").filter("n >= least").select("a", "b")
    # All blocks with a frequent run, those that are not cut, too: their bodies count.
    some = found.filter("NOT page").join(often, ["a", "b"]).groupBy("key")
    some, _ = write_table(some.agg(F.collect_set("block").alias("blocks")), "blocks")
    if some.isEmpty():
        return some.select("key", F.array().cast("array<struct<block:int,token:int>>").alias("places"))

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, host, html, blocks in zip(batch["key"], batch["host"], batch["html"], batch["blocks"], strict=True):
                found = blocks_of(html)
                body, article = _body(found), _has_article(found)
                for number in blocks:
                    kind, text = found[number]
                    cut = kind == "main" or not article
                    rows += [(host, head, key, body, int(number), at, cut) for at, head in heads(text, run, depth=max(run, DEPTH))]
            yield pd.DataFrame(rows, columns=["host", "head", "key", "body", "block", "token", "cut"])

    parsed = named.join(some, "key").select("key", "host", "html", "blocks").mapInPandas(
        suffixes, "host string, head string, key long, body long, block int, token int, cut boolean"
    )
    # Written, as bounds of ranges are sampled before rows are dealt.
    parsed, _ = write_table(parsed, "heads")
    placed = repeats(parsed, run).withColumn("host", F.xxhash64("host"))
    counted = placed.groupBy("host", "repeat").agg(F.count_distinct("body").alias("n")).join(hosts, "host")
    hits = placed.filter("cut").join(counted.filter("n >= least").select("repeat"), "repeat")
    return hits.groupBy("key").agg(F.collect_set(F.struct("block", "token")).alias("places"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", run: int = RUN) -> DataFrame:
    """``pages`` with ``main_text``: the main text of each, '' if there is none."""
    key = F.xxhash64(*[F.col(f"`{c}`") for c, kind in pages.dtypes if "map<" not in kind and kind != "variant"])
    name, found = unused(pages, "_key", "_places")
    named = pages.withColumn(name, key)
    places, _ = write_table(
        repeated_places(named.select(F.col(name).alias("key"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")), run),
        "places",
    )
    met = named.join(places.withColumnsRenamed({"key": name, "places": found}), name, "left")

    @F.pandas_udf("string")
    def texts(pages: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for html, places in zip(pages, marks, strict=True):
            by_block: dict[int, list[int]] = {}
            for p in places if places is not None else ():
                by_block.setdefault(p["block"], []).append(p["token"])
            out.append(main_text(html, by_block))
        return pd.Series(out, dtype=object)

    return met.withColumn("main_text", texts(F.col(html_col), F.col(found))).drop(name, found)
