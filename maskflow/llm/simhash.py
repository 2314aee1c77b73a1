"""SimHash near duplicates by vantage-point trees over ranges of fingerprint bits.

A fingerprint has 64 bits; two texts are near if at most ``max_distance`` bits
differ. One tree over all bits prunes little, as unrelated fingerprints lie 32
bits apart give or take 4. So the bits are cut into ``trees`` ranges: of two
near fingerprints, some range differs in ``max_distance // trees`` bits or
fewer (pigeonhole). Each range has a vantage-point tree of its own: a node
parts fingerprints by their Hamming distance, on that range, to its vantage
point, and the triangle inequality tells which sides a ball of that radius can
reach. Every fingerprint has one home shard (leaf) per tree and visits the
shards that its ball overlaps. Within a shard all 64 bits are compared, so the
pairs are exact, whatever sample the trees were made from.

The trees are fitted on a bounded sample (``SAMPLE`` fingerprints, smallest
hash first); all fingerprints are indexed. Equal fingerprints are folded
first, and oversized shards are compared in pairs of blocks.

Defined results: a null, empty or wordless text has fingerprint 0 and is
linked like any other; fewer words than a shingle make one shingle of all
words; rows with equal ids are separate rows; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskflow.llm.common import connected, forest, groups_of, in_blocks, unused, write_table

#: Fingerprints from which the trees are fitted.
SAMPLE = 16384
#: Home fingerprints that a shard should have, and rows, visitors included, that a block may have.
SHARD, BLOCK = 2048, 16384

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the lower-cased (A-Z) words' shingles under XXH64, seed 42; unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - width + 1
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)]
    values = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), 65536):
        bits = np.unpackbits(values[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(values)).tolist())


def with_fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4, name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return docs.withColumn(name, prints(F.col(text_col)))


def bit_ranges(trees: int) -> list[int]:
    """Masks that cut 64 bits into ranges of about equal length."""
    edges = [64 * i // trees for i in range(trees + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


class Tree:
    """A vantage-point tree over the bits of ``mask``; its leaves are shards."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaf: int):
        self.mask, self.radius = np.uint64(mask), radius
        self.point, self.limit, self.inner, self.outer = [], [], [], []
        self.leaves = 0
        rng = np.random.default_rng(7)
        todo = [(sample, None, 0)]
        self.root = 0
        while todo:
            own, parent, side = todo.pop()
            at = self._node(own, leaf, rng)
            if parent is not None:
                (self.inner if side == 0 else self.outer)[parent] = at
            else:
                self.root = at
            if at >= 0:
                d = self._distance(own, self.point[at])
                todo += [(own[d <= self.limit[at]], at, 0), (own[d > self.limit[at]], at, 1)]
        for name, kind in (("point", np.uint64), ("limit", np.int64), ("inner", np.int64), ("outer", np.int64)):
            setattr(self, name, np.array(getattr(self, name), dtype=kind))

    def _distance(self, values, point):
        return np.bitwise_count((values ^ point) & self.mask).astype(np.int64)

    def _node(self, own: np.ndarray, leaf: int, rng) -> int:
        """Number of a new inner node, or ``-1 - shard`` of a new leaf."""
        best = None
        if len(own) > leaf:
            for v in rng.choice(own, size=min(8, len(own)), replace=False):
                d = self._distance(own, v)
                limit = int(np.median(d))
                limit -= int((d <= limit).all())
                inside, near = (d <= limit).mean(), ((d > limit) & (d <= limit + self.radius)).mean()
                if 0 < inside < 1 and (best is None or abs(inside - 0.5) + near < best[0]):
                    best = (abs(inside - 0.5) + near, v, limit)
        if best is None:
            self.leaves += 1
            return -self.leaves
        self.point.append(best[1])
        self.limit.append(best[2])
        self.inner.append(0)
        self.outer.append(0)
        return len(self.point) - 1

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): one home shard per value, and the shards that its ball overlaps.

        Where two near values part at a node, the outer one visits the inner
        side; the inner one needn't go out, as the pair then meets already.
        """
        row, node, home = np.arange(len(values)), np.full(len(values), self.root), np.ones(len(values), dtype=bool)
        out = []
        while len(row):
            done = node < 0
            out.append((row[done], -1 - node[done], home[done]))
            row, node, home = row[~done], node[~done], home[~done]
            d, limit, r = self._distance(values[row], self.point[node]), self.limit[node], self.radius
            inside = np.where(home, d <= limit, d <= limit + r)
            outside = np.where(home, d > limit, d > limit - r)
            guest = home & (d > limit) & (d <= limit + r)
            row, node, home = (
                np.concatenate([row[inside], row[outside], row[guest]]),
                np.concatenate([self.inner[node[inside]], self.outer[node[outside]], self.inner[node[guest]]]),
                np.concatenate([home[inside], home[outside], np.zeros(int(guest.sum()), dtype=bool)]),
            )
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_edges(prints: DataFrame, column: str = "fingerprint", max_distance: int = 4, trees: int = 3) -> DataFrame:
    """(a, b): edges that connect all distinct fingerprints within ``max_distance`` bits.

    Each compared block gives a spanning forest of the near pairs in it, not
    the pairs: the edges are as many as the fingerprints at most, and connect
    the same.
    """
    distinct = prints.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("value"), "value").limit(SAMPLE).collect()
    sample = np.array([r[0] for r in sample], dtype=np.int64).view(np.uint64)
    leaf = max(1, int(SHARD * len(sample) / max(n, 1)))
    radius = max_distance // trees
    wood = [Tree(sample, mask, radius, leaf) for mask in bit_ranges(trees)]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["value"].to_numpy(dtype=np.int64)
            for number, tree in enumerate(wood):
                row, shard, home = tree.route(values.view(np.uint64))
                yield pd.DataFrame({"tree": np.int32(number), "shard": shard.astype(np.int64), "value": values[row], "home": home})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups_of(batches, ["tree", "shard", "lo", "hi"]):
            values, home, part = (group[c].to_numpy() for c in ("value", "home", "part"))
            lo, hi = group["lo"].iat[0], group["hi"].iat[0]
            left = np.flatnonzero(part == lo)
            right = left if lo == hi else np.flatnonzero(part == hi)
            bits, pairs = values.view(np.uint64), []
            # Visitors meet each other elsewhere: homes of either block against the other's rows.
            for own, others in ((left[home[left]], right), (right[home[right]], left[~home[left]])):
                for i in range(0, len(own), 256):
                    some = own[i : i + 256]
                    x, y = np.nonzero(np.bitwise_count(bits[some][:, None] ^ bits[others][None, :]) <= max_distance)
                    x, y = some[x], others[y]
                    pairs.append((x[x != y], y[x != y]))
            a, b = (np.concatenate(p) for p in zip(*pairs, strict=True)) if pairs else ([], [])
            if len(a):
                links = np.array(forest(len(values), a, b))
                yield pd.DataFrame({"a": values[links[:, 0]], "b": values[links[:, 1]]})

    routed = distinct.mapInPandas(route, "tree int, shard long, value long, home boolean")
    keys = ["tree", "shard", "lo", "hi"]
    blocks = in_blocks(routed, ["tree", "shard"], F.xxhash64("value"), BLOCK)
    return blocks.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(compare, "a long, b long")


def components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4, trees: int = 3
) -> DataFrame:
    """(doc_id, fingerprint, component, component_id, first) of each row of ``docs``.

    ``component``: smallest fingerprint (signed) that links reach;
    ``component_id``: smallest id there, nulls aside; ``first``: (doc_id,
    text hash) of the row that stands for the component.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    named = with_fingerprints(named, "_text", width).select("doc_id", "fingerprint", F.xxhash64("_text").alias("text_hash"))
    prints, _ = write_table(named, "fingerprints")
    groups = connected(near_edges(prints, "fingerprint", max_distance, trees))
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_hash"))
    each = prints.groupBy("fingerprint").agg(first.alias("first"))
    each = each.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    each = each.withColumn("component", F.coalesce("component", "fingerprint"))
    least = each.groupBy("component").agg(F.min("first").alias("first"))
    label = each.select("fingerprint", "component").join(least, "component")
    return prints.join(label, "fingerprint").withColumn("component_id", F.col("first.doc_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4) -> DataFrame:
    """One row of each near-duplicate group, the one with the smallest id; columns as in ``docs``.

    The rows that stay are told by id and text hash in a narrow table; the
    texts are exchanged once. Of rows equal in both, one stays.
    """
    found = components(docs, id_col, text_col, width, max_distance)
    first, its_hash, here, nth = unused(docs, "_first", "_hash", "_here", "_nth")
    stays = found.select(F.col("first.doc_id").alias(first), F.col("first.text_hash").alias(its_hash)).distinct()
    rows = docs.withColumn(here, F.xxhash64(text_col))
    match = F.col(id_col).eqNullSafe(F.col(first)) & (F.col(here) == F.col(its_hash))
    rows = rows.join(stays.hint("shuffle_hash"), match, "left_semi")
    number = F.row_number().over(Window.partitionBy(id_col, here).orderBy(F.lit(0)))
    return rows.withColumn(nth, number).filter(F.col(nth) == 1).select(*docs.columns)
