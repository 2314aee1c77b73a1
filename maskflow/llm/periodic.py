"""Runs: stretches of words that repeat themselves with a period, found by longest common extensions.

For a list of words two suffix trees are built by Ukkonen's algorithm, of the
list and of its reversal. An Euler tour of a tree meets its leaves in the order
of their suffixes, and between two neighbours the node where they part; the
shallowest such node between two leaves is their lowest common ancestor, and
its depth the longest common extension of the two places. A sparse table of
the tour's depths answers this in constant time.

The longest Lyndon word that starts at a place ends before the next smaller
suffix, and under the reversed order of words before the next larger one. Each
run has a place whose longest Lyndon word, under one of the orders, is as long
as the period (the runs theorem), so these two candidates for each place,
extended as far as the words agree to the right and to the left, give all
runs, each with its smallest period.

Only stretches that can hold a run get trees. A run of length n >= max(12, 2 q)
with period q agrees with itself q words on at six places in a row or more, and
the six-word grams there, with their copies q words on, cover all of it. So a
stretch is cut down to the words that lie in a gram that stands in the stretch
twice, and each piece again, until nothing goes. No run is lost or cut by this.

Defined results: a null text has no words and no runs; white space of any kind
counts as one space in the collapsed text; very long texts are one row each,
with memory in proportion to the words that repeated grams cover; equal rows
give equal results; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.functions.detect import let
from maskflow.llm.common import word_array

#: Words of the shortest run. The six-word grams of ``stretches`` follow from it.
LEAST = 12
GRAM = LEAST // 2
#: Bytes of texts whose grams are sorted together.
TOGETHER = 8_000_000

_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


# Suffix trees ---------------------------------------------------------------------------


class _Tree:
    """Suffix tree of numbers (1 and up) with common extensions of any two suffixes.

    ``rank``: the place of each suffix among all in ascending order, the empty one included.
    """

    def __init__(self, numbers: Sequence[int], letters: int):
        s = [*numbers, 0]
        n = len(s)
        start, end, suffix, edges = self._grow(s, letters)
        # Children of each node side by side, in the order of their first number.
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        kids = np.fromiter(edges.values(), np.int64, len(edges))
        del edges
        order = np.argsort(keys)
        kids = kids[order].tolist()
        first = np.searchsorted(keys[order] // letters, np.arange(len(start) + 1)).tolist()
        leaves, parting = [], []
        todo = [(0, 0, -1)]  # node, its depth, depth of the node where it parts from the leaf before
        while todo:
            node, depth, before = todo.pop()
            if before >= 0:
                parting.append(before)
            if suffix[node] >= 0:
                leaves.append(suffix[node])
                continue
            low, high = first[node], first[node + 1]
            for at in range(high - 1, low, -1):
                kid = kids[at]
                todo.append((kid, depth + end[kid] - start[kid], depth))
            kid = kids[low]
            todo.append((kid, depth + end[kid] - start[kid], -1))
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        table = [np.array(parting, dtype=np.int32)]
        while 2 ** len(table) <= len(parting):
            half = 2 ** (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    @staticmethod
    def _grow(s: list[int], letters: int) -> tuple[list[int], list[int], list[int], dict[int, int]]:
        """Ukkonen's algorithm: (start, end) of the edge into each node, the suffix of each leaf, edges by node and number."""
        n = len(s)
        start, end, suffix, link = [0], [0], [-1], [0]
        edges: dict[int, int] = {}
        find = edges.get
        node = edge = length = waiting = 0
        for i in range(n):
            c = s[i]
            made = 0
            waiting += 1
            while waiting:
                if not length:
                    edge = i
                key = node * letters + s[edge]
                kid = find(key)
                if kid is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    suffix.append(i - waiting + 1)
                    link.append(0)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    at = start[kid]
                    span = end[kid] - at
                    if length >= span:
                        edge += span
                        length -= span
                        node = kid
                        continue
                    if s[at + length] == c:
                        if made:
                            link[made] = node
                        length += 1
                        break
                    fork = len(start)
                    edges[key] = fork
                    start += (at, i)
                    end += (at + length, n)
                    suffix += (-1, i - waiting + 1)
                    link += (0, 0)
                    start[kid] = at + length
                    edges[fork * letters + s[at + length]] = kid
                    edges[fork * letters + c] = fork + 1
                    if made:
                        link[made] = fork
                    made = fork
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return start, end, suffix, edges

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes at ``i`` and ``j``, all i <> j."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(low), np.int64)
        for at in np.unique(level):
            here = level == at
            row = self.table[at]
            out[here] = np.minimum(row[low[here]], row[high[here] - 2**at])
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank; the length if there is none."""
    out, waiting = [len(rank)] * len(rank), []
    for j, r in enumerate(rank):
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = j
        waiting.append(j)
    return out


def runs_of(words: Sequence) -> np.ndarray:
    """All runs of two periods or more: rows (start, length, period), in ascending order."""
    n = len(words)
    if n < 2:
        return np.empty((0, 3), np.int64)
    known: dict = {}
    numbers = [known.setdefault(w, len(known) + 1) for w in words]
    tree = _Tree(numbers, len(known) + 1)
    back = _Tree(numbers[::-1], len(known) + 1)
    rank = tree.rank.tolist()
    places = np.arange(n)
    found = []
    for order in (rank, [-r for r in rank]):
        ends = np.array(_next_smaller(order)[:n], dtype=np.int64)
        some = ends < n + 1
        # Under the reversed order the empty suffix is the largest, so a word may have no end.
        i, j = places[some], ends[some]
        right = tree.extension(i, j)
        left = back.extension(n - i, n - j)
        low, high, period = i - left, j + right, j - i
        two = high - low >= 2 * period
        found.append(np.stack([low, high - low, period], axis=1)[two])
    return np.unique(np.concatenate(found), axis=0)


# Stretches ------------------------------------------------------------------------------


def stretches(codes: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """(low, high) of the stretches that can hold a run of ``LEAST`` words or more.

    ``codes``: a number for each word, equal for equal words; ``text``: the number of its text, ascending.
    """
    at, group = np.arange(len(codes)), text
    codes = codes.astype(np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    while len(at) >= LEAST:
        m = len(at) - GRAM + 1
        key = group[:m].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in range(GRAM):
            key = (key ^ (key >> np.uint64(29))) * factor + codes[k : k + m]
        inside = group[:m] == group[GRAM - 1 :]
        key = key[inside]
        # A gram whose low bits nobody shares stands once; only the others are sorted.
        low = (key & np.uint64(2 ** max(10, len(key).bit_length() + 1) - 1)).astype(np.int64)
        shared = np.bincount(low)[low] > 1
        order = np.sort(key[shared])
        twice = order[1:][order[1:] == order[:-1]]
        again = np.zeros(m, dtype=bool)
        again[np.flatnonzero(inside)[shared]] = np.isin(key[shared], twice)
        step = np.zeros(len(at) + 1, np.int64)
        step[:m] += again
        step[GRAM : GRAM + m] -= again
        kept = np.cumsum(step)[:-1] > 0
        gone = len(at) - np.count_nonzero(kept)
        at, codes, old = at[kept], codes[kept], group[kept]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) > 1) | (old[1:] != old[:-1])
        group = np.cumsum(new)
        if gone * 20 <= len(at):
            break
    else:
        return []
    cuts = np.flatnonzero(np.append(new, True))
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a >= LEAST]


def _find(texts: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, collapsed text) of each text."""
    split = [(t or b"").split() for t in texts]
    sizes = [len(words) for words in split]
    codes = np.fromiter((hash(w) for words in split for w in words), np.int64, sum(sizes))
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found: dict[int, list] = {}
    for low, high in stretches(codes, np.repeat(np.arange(len(split)), sizes)):
        which = int(np.searchsorted(first, low, side="right")) - 1
        low, high = low - int(first[which]), high - int(first[which])
        runs = runs_of(split[which][low:high])
        runs = runs[runs[:, 1] >= LEAST]
        found.setdefault(which, []).extend((s + low, n, p) for s, n, p in runs.tolist())
    for which, words in enumerate(split):
        runs = sorted((s, p, n) for s, n, p in found.get(which, ()))
        kept = words
        if runs:
            drop = np.zeros(len(words) + 1, np.int64)
            for s, p, n in runs:
                drop[s + p] += 1
                drop[s + n] -= 1
            kept = [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
        yield len(words), [{"start": s, "length": n, "period": p} for s, p, n in runs], b" ".join(kept)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text, and the text without their repeats.

    ``runs``: array of (start, length, period) by start and period, in words,
    each of at least ``LEAST`` words and two periods. ``collapsed``: the words
    that no run holds after its first period, joined by one space.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, texts = 0, batch.column(1)
            while low < len(batch):
                high, size = low, 0
                while high < len(batch) and (high == low or size < TOGETHER):
                    size += len(texts[high].as_buffer() or b"")
                    high += 1
                rows = list(_find(texts.slice(low, high - low).to_pylist()))
                counts, runs, kept = zip(*rows, strict=True)
                made = [batch.column(0).slice(low, high - low), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_words", "runs", "collapsed"])
                low = high

    wanted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = wanted.mapInArrow(search, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def longest_run(runs: Column) -> Column:
    """The run of greatest length, at ties the first, then the one of smallest period; null without runs."""
    ordered = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ordered)


def repeat_tail(text: Column, seed: Column) -> Column:
    """Words from ``a`` on replaced by the ``p`` words there over and over; null text or seed: the text.

    a = seed % n and p = 1 + floor((n - a) / (3 + seed % 8)) for n words; a text without words stays.
    """

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (seed % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + seed % 8))).cast("int")
        cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")

    return F.when(text.isNull() | seed.isNull(), text).otherwise(
        let(word_array(text), lambda w: F.when(F.size(w) == 0, text).otherwise(repeated(w)))
    )
