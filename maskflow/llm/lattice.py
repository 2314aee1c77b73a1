"""Near duplicates of embeddings by E8 lattice hashing.

Each table projects the unit vectors at random to a few blocks of eight
dimensions, shifts and scales them, and decodes each block to its nearest
point of the E8 lattice; the points of a table's blocks make a cell. A vector
is at home in one cell per table and probes the cells that differ in one block
by the lattice step which leads nearest. Vectors that share a cell, one of
them at home, are compared by cosine in double precision; the rest are not.

Equal vectors are folded first. Keys are narrow rows; vectors are read for
keys with company only. Cells of any size are compared in pairs of blocks, and
a block gives link counts and a spanning forest, never pairs. A pair that
meets in several cells is counted in the first of them, which both vectors'
codes tell.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components link with nothing, and so do vectors of different
lengths; copies of a vector link with each other; rows with the same id are
separate vectors; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.llm.common import connected, forest, groups_of, in_blocks, write_table

#: Rows that a block of a cell may have, on average.
BLOCK = 1024


@dataclass(frozen=True)
class Lattice:
    """``tables`` of ``blocks`` E8 blocks; ``step`` scales the lattice; ``probes`` cells per block besides the home."""

    tables: int = 12
    blocks: int = 2
    step: float = 0.95
    probes: int = 1
    seed: int = 11


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that they are whole numbers."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((-2, 2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in itertools.product((-1, 1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, dtype=np.int64)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest whole-number point with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(axis=-1)[..., None]
    turn = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
    odd = near.sum(axis=-1, keepdims=True) % 2 != 0
    moved = near.copy()
    np.put_along_axis(moved, worst, np.take_along_axis(near, worst, -1) + turn, -1)
    return np.where(odd, moved, near)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row of eight numbers: of the whole or of the half points."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(-1, keepdims=True) <= ((x - half) ** 2).sum(-1, keepdims=True)
    return np.where(closer, whole, half)


def cells(units: np.ndarray, how: Lattice) -> np.ndarray:
    """Cell numbers (row, table, 1 + blocks * probes) of unit vectors; the first is the home."""
    n, dim = units.shape
    rng = np.random.default_rng([how.seed, dim])
    wide = how.tables * how.blocks * 8
    turn = rng.normal(size=(dim, wide)) / np.sqrt(8.0)
    shift = rng.uniform(0, 2, size=wide)
    mix = rng.integers(-(2**62), 2**62, size=(how.tables, how.blocks, 8), dtype=np.int64) * 2 + 1
    around = roots()
    x = (units @ turn / how.step + shift).reshape(n, how.tables, how.blocks, 8)
    point = nearest_e8(x)
    with np.errstate(over="ignore"):
        home = ((2 * point).astype(np.int64) * mix).sum(axis=(-1, -2)) + dim
        out = [home[..., None]]
        if how.probes:
            best = np.argpartition(-((x - point) @ around.T), how.probes - 1, axis=-1)[..., : how.probes]
            moves = (around[None, None] * mix[:, :, None, :]).sum(-1)  # table, block, root
            t, b = np.arange(how.tables)[:, None, None], np.arange(how.blocks)[None, :, None]
            out.append(home[..., None] + moves[t, b, best].reshape(n, how.tables, -1))
    return np.concatenate(out, axis=-1)


def _units(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(table, cell) of the first cell that vectors with codes ``a`` and ``b`` share, one of them at home."""
    table, cell = np.full(len(a), a.shape[1]), np.zeros(len(a), dtype=np.int64)
    high = np.iinfo(np.int64).max
    for t in reversed(range(a.shape[1])):
        x, y = a[:, t, 0], b[:, t, 0]
        there = (b[:, t] == x[:, None]).any(axis=1)
        here = (a[:, t] == y[:, None]).any(axis=1)
        least = np.minimum(np.where(there, x, high), np.where(here, y, high))
        hit = there | here
        table[hit], cell[hit] = t, least[hit]
    return table, cell


def usable(vector: Column) -> Column:
    """True where a vector can link: not null or empty, all components finite, not all zero."""
    big = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < big), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_name(vector: Column) -> Column:
    """128 bits that name a vector's value."""
    return F.concat(F.hex(F.xxhash64(vector)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), vector)))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, how: Lattice = Lattice()
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    ``n_links``: other rows linked directly; ``component_id``: smallest id
    that links reach.
    """
    given = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    good = usable(F.col("vector"))
    classes = given.filter(good).groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes, _ = write_table(classes.withColumn("name", vector_name(F.col("vector"))), "vectors")

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, some in batch.groupby(batch["vector"].map(len), sort=False):
                for i in range(0, len(some), 1024):
                    part = some.iloc[i : i + 1024]
                    found = cells(_units(part["vector"]), how)
                    n, tables, each = found.shape
                    at = np.indices(found.shape)
                    yield pd.DataFrame(
                        {
                            "name": part["name"].to_numpy()[at[0].ravel()],
                            "lattice": at[1].ravel().astype(np.int32),
                            "cell": found.ravel(),
                            "home": at[2].ravel() == 0,
                        }
                    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in groups_of(batches, ["lattice", "cell", "lo", "hi"]):
            table, cell, lo, hi = (group[c].iat[0] for c in ("lattice", "cell", "lo", "hi"))
            home, part, copies = (group[c].to_numpy() for c in ("home", "part", "copies"))
            left = np.flatnonzero(part == lo)
            right = left if lo == hi else np.flatnonzero(part == hi)
            if not len(left) or not len(right) or not home.any():
                continue
            units, pairs = _units(group["vector"]), []
            for i in range(0, len(left), 512):
                some = left[i : i + 512]
                near = (units[some] @ units[right].T >= cosine) & (home[some][:, None] | home[right][None, :])
                x, y = np.nonzero(near)
                x, y = some[x], right[y]
                once = x < y if lo == hi else slice(None)
                pairs.append((x[once], y[once]))
            a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
            if not len(a):
                continue
            codes, links = cells(units, how), np.zeros(len(group), dtype=np.int64)
            for i in range(0, len(a), 65536):
                x, y = a[i : i + 65536], b[i : i + 65536]
                first = _first_meeting(codes[x], codes[y])
                mine = (first[0] == table) & (first[1] == cell)
                np.add.at(links, x[mine], copies[y[mine]])
                np.add.at(links, y[mine], copies[x[mine]])
            names = group["name"].to_numpy()
            root = np.arange(len(group))
            for x, r in forest(len(group), a, b):
                root[x] = r
            told = np.unique(np.concatenate([a, b]))
            yield pd.DataFrame({"name": names[told], "root": names[root[told]], "links": links[told]})

    keys = classes.select("name", "vector").mapInPandas(code, "name string, lattice int, cell long, home boolean")
    # A vector may reach one cell twice; the home row stands for both.
    keys = keys.groupBy("name", "lattice", "cell").agg(F.max("home").alias("home"))
    dealt = in_blocks(keys, ["lattice", "cell"], F.xxhash64("name"), BLOCK)
    order = ["lattice", "cell", "lo", "hi"]
    met = dealt.join(classes.select("name", "vector", "copies"), "name")
    found, _ = write_table(
        met.repartition(*order).sortWithinPartitions(*order).mapInPandas(compare, "name string, root string, links long"), "links"
    )
    groups = connected(found.select("name", "root"), "name", "root").withColumnRenamed("node", "name")
    counts = found.groupBy("name").agg(F.sum("links").alias("links"))
    each = classes.select("name", "least", "copies").join(groups, "name", "left").join(counts, "name", "left")
    each = each.withColumn("component", F.coalesce("component", "name"))
    least = each.groupBy("component").agg(F.min("least").alias("component_id"))
    label = each.join(least, "component").select(
        "name", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    named = given.select("vec_id", F.when(good, vector_name(F.col("vector"))).alias("name"))
    out = named.join(label, "name", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
