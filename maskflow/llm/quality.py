"""Quality rules as a short-circuit cascade, cheapest rejection first.

A rule is a condition on a few measures of a text. On a bounded sample the
share that each rule rejects and the time that it takes are measured; rules
are then asked in order of rejection per cost, and a text that one rule
rejects is not measured for the next ones (a CASE evaluates a branch only if
the ones before it fail). The order changes the cost, never the verdict.

DataFrame functions only, one pass, no shuffle.

Defined results: a null or empty text has no words and fails ``few_words``;
rows are judged one by one, so repeated rows and ties have equal verdicts;
an empty table gives no rows and keeps the rules in the order given.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions.detect import compute_once, let
from maskflow.llm.common import SPACE_CHARS, word_array, word_count

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in a repeated-window test.
WINDOW = 3


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")).cast("long")


def symbol_count(text: Column) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("long")


def _word_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(lines, lambda line: F.length(F.translate(line, SPACE_CHARS, "")) > 0)


def line_count(text: Column) -> Column:
    """Lines that have a word."""
    return F.size(_word_lines(text)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_word_lines(text), lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def repeated_words(text: Column) -> Column:
    """Words that lie in a window of three words found twice or more in the text.

    Windows are compared by a 64-bit hash. Most texts repeat none, which a
    hash set tells; the others sort (hash, place) and count the places that
    the repeated windows cover. Linear but for the sort, whatever the length.
    """

    def hashes(words: Column) -> Column:
        each = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
        return F.slice(each, 1, F.greatest(F.lit(0), F.size(words) - (WINDOW - 1)))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            hit = F.transform(s, lambda x, k: F.when(twin(x, k - 1) | twin(x, k + 1), x["i"]))
            return F.sort_array(F.filter(hit, F.isnotnull))

        def total(p: Column) -> Column:
            step = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(step, F.lit(0), lambda a, b: a + b)

        return let(let(pairs, places), total)

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(covered(found))

    return let(let(word_array(text), hashes), count).cast("long")


#: Measures by name, each of a text column.
MEASURES: Mapping[str, Callable[[Column], Column]] = {
    "n_words": word_count,
    "word_chars": word_chars,
    "n_symbols": symbol_count,
    "n_lines": line_count,
    "n_dup_lines": duplicate_lines,
    "n_repeat_words": repeated_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects``: condition on the named measures; true rejects the text."""

    name: str
    measures: tuple[str, ...]
    rejects: Callable[..., Column]


#: The rules in the order that holds without a sample.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("short_words", ("n_words", "word_chars"), lambda n, chars: chars < 2 * n),
    Rule("long_words", ("n_words", "word_chars"), lambda n, chars: chars > 20 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, symbols: 10 * symbols > 3 * n),
    Rule("same_lines", ("n_lines", "n_dup_lines"), lambda lines, same: 2 * same > lines),
    Rule("same_words", ("n_words", "n_repeat_words"), lambda n, repeated: 100 * repeated > 50 * n),
)


def _condition(rule: Rule, text: Column, ready: Sequence[str]) -> Column:
    """The rule's condition; measures that are columns in ``ready`` are used as they are."""
    return rule.rejects(*[F.col(m) if m in ready else MEASURES[m](text) for m in rule.measures])


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All measures as columns (in place of such columns), each made once per row."""
    return compute_once(docs.drop(*MEASURES), {name: make(F.col(text_col)) for name, make in MEASURES.items()})


def estimate(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds) of each rule on a sample of at most ``sample_rows`` rows.

    The sample only sets the order of the rules. It is the first rows that a
    scan meets, so that estimating costs the same for any table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("_text")).limit(sample_rows).collect()
    if not rows:
        return [(r.name, 0.0, 0.0) for r in rules]
    sample = spark.createDataFrame(rows, "_text string").coalesce(1).cache()
    try:
        sample.count()
        out = []
        for rule in rules:
            test = sample.agg(F.count_if(F.coalesce(_condition(rule, F.col("_text"), ()), F.lit(True))))
            test.first()  # compiles
            start = time.perf_counter()
            rejected = test.first()[0]
            out.append((rule.name, rejected / len(rows), time.perf_counter() - start))
        return out
    finally:
        sample.unpersist()


def order_rules(estimates: Sequence[tuple[str, float, float]], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules by rejection per second, highest first; ties keep the order given."""
    gain = {name: share / max(cost, 1e-6) for name, share, cost in estimates}
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, ready: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``rejected_by``: the first rule, in the order given, that rejects, or null."""
    text = F.col(text_col)
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(_condition(rule, text, ready), F.lit(rule.name)).otherwise(verdict)
    return docs.withColumn("rejected_by", verdict)


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``."""
    ordered = order_rules(estimate(docs, text_col, rules, sample_rows), rules)
    text = F.col(text_col)
    verdict = F.lit(True)
    for rule in reversed(ordered):
        verdict = F.when(_condition(rule, text, ()), F.lit(False)).otherwise(verdict)
    return docs.filter(verdict)
