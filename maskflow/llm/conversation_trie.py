"""Prefix trie of conversations: adaptive radix trees over turn ids, built in tasks and merged.

A turn (role, text) is known by a 16-byte id, two 64-bit hashes in big-endian
order, so a conversation is a byte string and a prefix of d turns is its first
16 d bytes. Each task puts the byte strings it holds into adaptive radix trees
(nodes with room for 4, 16, 48 or 256 children, paths compressed) and gives
out, for each depth that is a whole number of turns, a part of a trie node:
how many conversations of the task pass, and the smallest. Parts of one node
are added up by the node's key, the exclusive or of the hashes of (turn id,
place) of its turns. So a first turn that a third of all conversations share
is dealt to many tasks, and each of them passes on one row for it.

Sums over subtrees need no walk over levels. Every node below v has a smallest
member, which also passes v. Let T(c) be what conversation c brings in over
all nodes it is smallest in; then the sum over v's subtree is the sum of T(c)
over v's members, but for v's own smallest member only what comes at v and
below. Sums over members are again sums over parts, in a second round of trees.

Long conversations are cut into segments of ``SEGMENT`` turns, each in a tree
under its prefix's key, and no row holds more than one segment. Turns are
numbered by a range sort, so no conversation need fit in one task. A tree is
given out and started anew once it holds ``TREE_BYTES`` of keys.

Defined results: null role or text counts as empty; turns of equal number
(null first) are ordered by the hash of role and text, and repeated rows are
separate turns; rows with a null conversation id belong to no conversation and
make no node; an empty table gives no nodes; other columns are ignored,
whatever their names; texts of any length only pass through hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskflow.llm.common import write_table

#: Turns of a conversation that one row and one tree hold at most.
SEGMENT = 256
#: Bytes of keys that a task holds in trees.
TREE_BYTES = 16_000_000
#: Bytes of a turn id.
WIDTH = 16
#: Conversation ids that one row of ``node_ends`` holds at most.
ENDS = 4096
#: Nodes with more than one in ``HEAVY`` of all children (so fewer than that many) are broadcast.
HEAVY = 1024

KEY = ["k1", "k2", "depth"]


# Trees ------------------------------------------------------------------------------


class _Few:
    """Up to 4 or 16 children: their bytes and the children side by side."""

    __slots__ = ("room", "bytes", "kids")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.kids = room, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.kids[at] if at >= 0 else None

    def put(self, byte: int, child):
        at = self.bytes.find(byte)
        if at >= 0:
            self.kids[at] = child
            return self
        if len(self.kids) == self.room:
            larger = _Few(16) if self.room == 4 else _Indexed()
            for b, kid in zip(self.bytes, self.kids, strict=True):
                larger.put(b, kid)
            return larger.put(byte, child)
        self.bytes.append(byte)
        self.kids.append(child)
        return self

    def all(self):
        return self.kids


class _Indexed:
    """Up to 48 children: a place for each of the 256 bytes says which."""

    __slots__ = ("place", "kids")

    def __init__(self):
        self.place, self.kids = bytearray(b"\xff" * 256), []

    def get(self, byte: int):
        at = self.place[byte]
        return self.kids[at] if at != 255 else None

    def put(self, byte: int, child):
        at = self.place[byte]
        if at != 255:
            self.kids[at] = child
            return self
        if len(self.kids) == 48:
            larger = _Direct()
            for b in range(256):
                if self.place[b] != 255:
                    larger.put(b, self.kids[self.place[b]])
            return larger.put(byte, child)
        self.place[byte] = len(self.kids)
        self.kids.append(child)
        return self

    def all(self):
        return self.kids


class _Direct:
    """A child for each byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, child):
        self.kids[byte] = child
        return self

    def all(self):
        return [k for k in self.kids if k is not None]


class _Node:
    """A compressed path and what passes its end."""

    __slots__ = ("path", "below", "n", "least", "sums", "example")

    def __init__(self, path: bytes, n: int, least: int, sums: tuple, example: int):
        self.path, self.below = path, _Few()
        self.n, self.least, self.sums, self.example = n, least, sums, example

    def add(self, name: int, more: tuple) -> None:
        self.n += 1
        if name < self.least:
            self.least = name
        if more:
            self.sums = (self.sums[0] + more[0], self.sums[1] + more[1])


class RadixTree:
    """Keys of bytes; each node counts the keys that pass it, with their smallest name and summed measures."""

    def __init__(self):
        self.root: _Node | None = None

    def insert(self, key: bytes, name: int, more: tuple, example: int) -> None:
        if self.root is None:
            self.root = _Node(b"", 0, name, (0, 0) if more else (), example)
        node, at = self.root, 0
        node.add(name, more)
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                node.below = node.below.put(key[at], _Node(key[at:], 1, name, more, example))
                return
            path = child.path
            if key.startswith(path, at):
                at += len(path)
                node = child
                node.add(name, more)
                continue
            here = key[at : at + len(path)]
            same = min(len(here), len(path))
            apart = int.from_bytes(here[:same], "big") ^ int.from_bytes(path[:same], "big")
            same -= (apart.bit_length() + 7) // 8
            fork = _Node(path[:same], child.n, child.least, child.sums, child.example)
            child.path = path[same:]
            fork.below = fork.below.put(child.path[0], child)
            fork.add(name, more)
            node.below = node.below.put(key[at], fork)
            if at + same < len(key):
                rest = key[at + same :]
                fork.below = fork.below.put(rest[0], _Node(rest, 1, name, more, example))
            return

    def paths(self) -> Iterator[tuple[_Node, int, int]]:
        """(node, depth before, depth at its end), in bytes; the root first."""
        todo = [(self.root, 0)] if self.root else []
        while todo:
            node, at = todo.pop()
            end = at + len(node.path)
            yield node, at, end
            todo.extend([(kid, end) for kid in node.below.all()])


_PARTS = "k1 long, k2 long, depth long, p1 long, p2 long, n_bytes long, conv_id long, n long, leaves long, total long"


def _grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments, sorted by (seg, s1, s2), to parts of trie nodes."""
    tree, group, held, size = RadixTree(), None, [], 0
    out, rows_out = [], 0

    def give() -> None:
        """The nodes of the tree, each at every whole turn of its path."""
        nonlocal rows_out
        found = list(tree.paths())
        if not found:
            return
        seg, s1, s2 = group
        low = np.array([at // WIDTH for _, at, _ in found])
        high = np.array([end // WIDTH for _, _, end in found])
        if seg == 0:
            low[0] = -1  # the textless root; that of a later segment is a node of the one before
        times = high - low
        which = np.repeat(np.arange(len(found)), times)
        depth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which] + 1
        example = np.array([node.example for node, _, _ in found])[which]
        starts = np.cumsum([0] + [len(h[0]) for h in held])[:-1][example]
        flat = [np.concatenate([h[i] for h in held] + [np.zeros(1, np.int64)]) for i in range(3)]
        at = starts + depth
        made = {"depth": depth + seg * SEGMENT}
        for name, i, start in (("1", 0, s1), ("2", 1, s2)):
            chain = flat[i]
            made[f"k{name}"] = np.where(depth > 0, chain[at - 1], start)
            made[f"p{name}"] = np.where(depth > 1, chain[at - 2], start)
        made["n_bytes"] = np.where(depth > 0, flat[2][at - 1], 0)
        made["conv_id"] = np.array([node.least for node, _, _ in found])[which]
        made["n"] = np.array([node.n for node, _, _ in found])[which]
        sums = np.array([node.sums or (0, 0) for node, _, _ in found], dtype=np.int64)[which]
        made["leaves"], made["total"] = sums[:, 0], sums[:, 1]
        out.append(pd.DataFrame(made)[[c.split()[0] for c in _PARTS.split(", ")]])
        rows_out += len(which)

    for batch in batches:
        weighed = "leaf" in batch.columns
        more = list(zip(batch["leaf"], batch["total"], strict=True)) if weighed else [()] * len(batch)
        rows = zip(*[batch[c] for c in ("conv_id", "seg", "s1", "s2", "a", "b", "x1", "x2", "n_bytes")], more, strict=True)
        for conv, seg, s1, s2, a, b, x1, x2, n_bytes, measures in rows:
            if (seg, s1, s2) != group or size > TREE_BYTES:
                give()
                tree, group, held, size = RadixTree(), (seg, s1, s2), [], 0
            key = np.stack([a, b], axis=1).astype(">i8").tobytes()
            chains = [np.bitwise_xor.accumulate(x) ^ np.int64(s) for x, s in ((x1, s1), (x2, s2))]
            tree.insert(key, conv, measures, len(held))
            held.append((*chains, n_bytes))
            size += len(key) + 64
            if rows_out > 50_000:
                yield pd.concat(out, ignore_index=True)
                out, rows_out = [], 0
    give()
    if out:
        yield pd.concat(out, ignore_index=True)


# Turns and segments -------------------------------------------------------------------


def number_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, pos, a, b, n_bytes): turns by their place in the conversation, from 0, and the halves of their ids.

    Numbered by a range sort of narrow rows and the counts of each
    (conversation, range), so the ranges of a hot conversation lie in many tasks.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    narrow = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),
    ).filter("conv_id is not null")
    order = ["conv_id", "turn", "a", "b", "row"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed, _ = write_table(ranged.drop("turn", "row").withColumn("at", place), "turns")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("conv_id", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("low", F.col("low") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    pos = (F.col("at") - F.col("low")).alias("pos")
    return placed.join(counts.drop("n"), ["conv_id", "part"]).select("conv_id", pos, "a", "b", "n_bytes")


def segments(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Conversations in rows of up to ``SEGMENT`` turns, with the key of what comes before, as a written table.

    ``turns``: conv_id, pos (0, 1, ... in each), a, b, n_bytes; ``convs``: conv_id, all conversations once.
    """
    x1, x2 = F.xxhash64("a", "b", "pos"), F.xxhash64(F.lit(1), "b", "a", "pos")
    turn = F.struct("pos", "a", "b", x1.alias("x1"), x2.alias("x2"), "n_bytes")
    seg = F.expr(f"pos div {SEGMENT}").alias("seg")
    each = turns.select("conv_id", seg, turn.alias("turn"))
    none = convs.select("conv_id", F.lit(0).cast("long").alias("seg"), F.lit(None).cast(each.schema["turn"].dataType).alias("turn"))
    cut = each.unionByName(none).groupBy("conv_id", "seg").agg(
        F.sort_array(F.collect_list("turn")).alias("turns"),
        *[F.coalesce(F.bit_xor(f"turn.{x}"), F.lit(0)).alias(f"t{i}") for i, x in ((1, "x1"), (2, "x2"))],
    )
    cut, _ = write_table(cut, "segments")
    # The start of a later segment; nearly all conversations have none.
    later = cut.filter("seg > 0").select("conv_id").distinct()
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.join(later, "conv_id", "left_semi").select(
        "conv_id", "seg", *[F.bit_xor(f"t{i}").over(before).alias(f"s{i}") for i in (1, 2)]
    )
    zero = F.lit(0).cast("long")
    first = cut.filter("seg = 0").withColumns({"s1": zero, "s2": zero})
    rest = cut.filter("seg > 0").join(starts.filter("seg > 0"), ["conv_id", "seg"])
    return first.unionByName(rest)


def _parts(segs: DataFrame) -> DataFrame:
    """Parts of trie nodes: neighbours by prefix share a task, and equal conversations are still divided."""
    narrow = segs.select(
        "conv_id", "seg", "s1", "s2", *[F.col(f"turns.{c}").alias(c) for c in ("a", "b", "x1", "x2", "n_bytes")],
        *[c for c in ("leaf", "total") if c in segs.columns],
    )
    order = ["seg", "s1", "s2", "a", "conv_id"]
    return narrow.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_grow, _PARTS)


# Nodes ---------------------------------------------------------------------------------


def trie(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and where each conversation ends.

    Nodes: k1, k2, depth (together the key), conv_id (smallest member),
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends: conv_id
    and the key of the node it ends in. Arguments as of ``segments``.
    """
    segs, _ = write_table(segments(turns, convs), "segments")
    merged = _parts(segs.drop("t1", "t2")).groupBy(*KEY).agg(
        *[F.min(c).alias(c) for c in ("p1", "p2", "n_bytes", "conv_id")], F.sum("n").alias("n_convs")
    )
    nodes, _ = write_table(merged, "nodes")
    up = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
    nodes = nodes.join(up.agg(F.count("*").alias("n_children")), KEY, "left").fillna(0, ["n_children"])
    worth = (F.col("n_convs") - 1) * F.col("n_bytes")
    part = F.expr(f"depth div {SEGMENT}")
    nodes, _ = write_table(nodes.withColumns({"worth": worth, "part": part}), "nodes")

    # What each conversation brings in, by part of its depths and in all.
    by_part = nodes.groupBy("conv_id", "part").agg(
        F.sum("worth").alias("sum"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.min("depth").alias("top")
    )
    after = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    by_part = by_part.select(
        "conv_id", "part",
        F.coalesce(F.sum("sum").over(after), F.lit(0)).alias("after"),
        F.sum("sum").over(whole).alias("total"), F.max("leaf").over(whole).alias("leaf"), F.min("top").over(whole).alias("top"),
    )
    by_part, _ = write_table(by_part, "brought")
    brought = by_part.groupBy("conv_id").agg(F.max("total").alias("total"), F.max("leaf").alias("leaf"))
    weighed = segs.drop("t1", "t2").join(brought, "conv_id", "left").fillna(0, ["total", "leaf"])
    sums = _parts(weighed).groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("total").alias("passed"))

    here = Window.partitionBy("conv_id", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    known = nodes.withColumn("own", F.sum("worth").over(here)).join(by_part.drop("leaf"), ["conv_id", "part"])
    known = known.join(sums, KEY).withColumn("saved_tokens", F.col("passed") - F.col("total") + F.col("own") + F.col("after"))

    # A node has its parent's smallest member but where that member's run of nodes begins.
    known, _ = write_table(known.withColumn("forks", (F.col("depth") == F.col("top")) & (F.col("depth") > 0)), "known")
    names = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id"), "n_children").filter("n_children > 0")
    heavy = F.col("n_children") > F.lit(nodes.count() / HEAVY)
    above = {"p1": "k1", "p2": "k2"}
    names = names.withColumnsRenamed({v: k for k, v in above.items()}).withColumn("depth", F.col("depth") + 1)
    on = ["p1", "p2", "depth"]
    forks = known.filter("forks")
    many = F.broadcast(names.filter(heavy).drop("n_children"))
    few = forks.join(many, on, "left_anti").join(names.filter(~heavy).drop("n_children"), on)
    same = F.when(F.col("depth") > 0, F.col("conv_id"))
    columns = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    found = known.filter("not forks").withColumn("parent_conv_id", same).select(*columns)
    found = found.unionByName(forks.join(many, on).select(*columns)).unionByName(few.select(*columns))

    last = segs.groupBy("conv_id").agg(
        F.max_by(F.struct(F.expr("s1 ^ t1").alias("k1"), F.expr("s2 ^ t2").alias("k2"), (F.col("seg") * SEGMENT + F.size("turns")).alias("depth")), "seg").alias("end")
    )
    return found, last.select("conv_id", "end.*")


def node_ends(ends: DataFrame) -> DataFrame:
    """(k1, k2, depth, chunk, conv_ids): the conversations that end in each node, ascending over the rows of a node.

    ``conv_ids`` is decimal, comma-joined and holds at most ``ENDS`` ids, so a
    node in which a third of all conversations end is many rows.
    """
    chunk = F.floor(F.col("conv_id") / F.lit(ENDS)) if ENDS & (ENDS - 1) else F.shiftright("conv_id", ENDS.bit_length() - 1)
    ids = F.array_join(F.sort_array(F.collect_set("conv_id")).cast("array<string>"), ",")
    return ends.withColumn("chunk", chunk).groupBy(*KEY, "chunk").agg(ids.alias("conv_ids"))


def _hash_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, chunk) to one hash for each key; holds one hash state."""
    now, state = None, None
    for batch in batches:
        done = []
        for k1, k2, depth, ids in zip(batch["k1"], batch["k2"], batch["depth"], batch["conv_ids"], strict=True):
            if (k1, k2, depth) != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (k1, k2, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=[*KEY, "sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, state.hexdigest())], columns=[*KEY, "sha256"])


def hash_ends(chunks: DataFrame) -> DataFrame:
    """(k1, k2, depth, sha256) of the comma-joined ids of ``node_ends``.

    A hash of one string cannot be made in parallel: the rows of a node, one in
    ``ENDS`` of its ids, pass one hash state in order.
    """
    chunks, _ = write_table(chunks, "ends")
    counts = chunks.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("chunk").alias("chunk"))
    one = chunks.join(counts.filter("n = 1").drop("n"), [*KEY, "chunk"]).select(*KEY, F.sha2(F.col("conv_ids").cast("binary"), 256).alias("sha256"))
    many = chunks.join(counts.filter("n > 1").select(*KEY), KEY)
    many = many.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return one.unionByName(many.mapInPandas(_hash_chunks, "k1 long, k2 long, depth long, sha256 string"))


def rebuild(turns: DataFrame, head: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Each conversation's first ``head`` turns taken from conversation ``base`` instead; (turns, conversations).

    Both are expressions over ``conv_id``; ``head`` must be small, as that many
    turns are kept together. All turns of a shorter base are taken, none of an absent one.
    """
    turns, _ = write_table(turns.withColumn("part", F.expr(f"pos div {SEGMENT}")), "numbered")
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    convs, _ = write_table(parts.groupBy("conv_id").agg(F.sum("n").alias("n")), "conversations")
    asked = convs.select("conv_id", head.cast("long").alias("head"), base.alias("base"))
    most = asked.agg(F.max("head")).first()[0] or 0
    heads = turns.filter(F.col("pos") < most).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b", "n_bytes"))).alias("taken")
    )
    asked = asked.join(heads, "base", "left")
    taken = F.coalesce(F.slice("taken", F.lit(1), F.col("head").cast("int")), F.array().cast(heads.schema["taken"].dataType))
    asked, _ = write_table(asked.select("conv_id", "head", taken.alias("taken")), "heads")
    shift = asked.select("conv_id", "head", F.size("taken").alias("kept"))
    moved = parts.drop("n").join(shift, "conv_id")  # a row per segment, not per turn
    own = turns.join(moved, ["conv_id", "part"]).filter("pos >= head")
    own = own.select("conv_id", (F.col("pos") - F.col("head") + F.col("kept")).alias("pos"), "a", "b", "n_bytes")
    front = asked.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.*")
    return front.unionByName(own), asked.select("conv_id")
