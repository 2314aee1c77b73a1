"""Prefix trie of conversations against plain Python."""

import hashlib
import random
import zlib

import pytest

from maskflow.llm import conversation_trie as ct
from maskflow.llm import queries

CONV = "conv_id long, turn long, role string, text string"
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The contract, prefix by prefix."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0))
    own = {c: [t[1:] for t in turns] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        below = kids.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) or 1
        size = len(key[-1][1].encode()) if key else 0
        saved[key] = (len(members[key]) - 1) * size + sum(saved[k] for k in below)
    out = []
    for key, who in members.items():
        ends = sorted(c for c in who if len(built[c]) == len(key))
        out.append((
            min(who), len(key), min(members[key[:-1]]) if key else None, len(who), len(kids.get(key, [])), leaves[key], saved[key],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(spark, rows, tmp_path, extra=()):
    df = spark.createDataFrame(rows, CONV)
    for c in extra:
        df = df.selectExpr("*", f"1 as `{c}`")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op11_conversation_trie"](spark, str(tmp_path))
    assert got.columns == OUT
    assert all(t == "bigint" for c, t in got.dtypes if c != "ends_sha256")
    return sorted(map(tuple, got.collect()), key=repr)


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, t * 2 - 4, rng.choice(["user", None, ""]), rng.choice(["a", "b", "é", "", None, "aa"])))
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark, tmp_path):
    rows = random_rows(1, 300)
    assert found(spark, rows, tmp_path, ["key", "pos", "k1", "seg"]) == brute(rows)


def test_long_conversations_and_common_prefixes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ct, "ENDS", 4)
    long = [("user", f"t{i}") for i in range(700)]
    rows = [(c, i, *t) for c in (10, 11, 12, 13) for i, t in enumerate(long)]
    rows += [(c, i, *t) for c in (20, 21) for i, t in enumerate([*long[:600], ("user", str(c)), *long[601:690]])]
    rows += [(c, i, "user", "same") for c in range(100, 400) for i in range(3)]
    rows += [(c, 0, "user", f"{c % 90}") for c in range(1000, 1300)]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(None, 1, "user", "x"), (1, None, "user", "first"), (1, 0, None, None), (1, 1, "", "")]
    rows += [(2, 5, "user", "twice"), (2, 5, "user", "twice"), (7, 0, "user", "x" * 300_000), (-3, 1, "a", "b")]
    assert found(spark, rows[:-1], tmp_path) == brute(rows[:-1])


def test_no_rows(spark, tmp_path):
    assert found(spark, [], tmp_path) == []


@pytest.mark.parametrize("size", [3, 4, 5, 16, 17, 48, 49, 256])
def test_node_layouts_grow(size):
    rng = random.Random(size)
    keys = [bytes([i]) + bytes(rng.randrange(256) for _ in range(7)) for i in rng.sample(range(256), size)]
    tree = ct.RadixTree()
    for name, k in enumerate(keys * 2):
        tree.insert(k, name, (1, name), name)
    layout = {3: "_Few", 4: "_Few", 5: "_Few", 16: "_Few", 17: "_Indexed", 48: "_Indexed", 49: "_Direct", 256: "_Direct"}[size]
    assert type(tree.root.below).__name__ == layout
    assert tree.root.n == 2 * size and tree.root.least == 0 and tree.root.sums == (2 * size, sum(range(2 * size)))
    assert sorted(node.path for node, at, end in tree.paths() if end == 8) == sorted(keys)
    assert all(node.n == 2 for node, at, end in tree.paths() if end == 8)


def test_tree_against_prefix_counts():
    rng = random.Random(3)
    keys = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) for _ in range(400)]
    tree = ct.RadixTree()
    for name, k in enumerate(keys):
        tree.insert(k, name, (), name)
    counted = {}
    for node, at, end in tree.paths():
        for d in range(at + (end > 0), end + 1):
            counted[keys[node.example][:d]] = (node.n, node.least)
    want = {}
    for name, k in enumerate(keys):
        for d in range(len(k) + 1):
            n, least = want.get(k[:d], (0, name))
            want[k[:d]] = (n + 1, min(least, name))
    assert counted == want


def test_sql_equals_brute_force():
    import duckdb

    from maskflow.llm.oracles import ORACLES

    rows = random_rows(5, 120) + [(-7, 0, "a", "b"), (None, 1, "user", "x")]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(ORACLES["op11_conversation_trie"]).fetchall(), key=repr) == brute(rows)
