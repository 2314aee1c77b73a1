"""Packing by length combinations: whole pieces, no padding, least squares."""

import functools
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskflow.llm import length_packing as lp
from maskflow.llm import queries
from maskflow.llm.queries import tokenizer_path

DOCS = "doc_id long, text string"


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(text, end):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [end]


def checked(rows, got, tokens, end):
    """Each id in exactly one piece, sequences gapless and full or a power of two; the number of pieces."""
    want = Counter()
    for doc_id, text in rows:
        ids = ids_of(text, end)
        want[(doc_id, tuple(ids))] += 1
    by_key, sequences = defaultdict(list), defaultdict(list)
    texts = defaultdict(list)
    for key, n in want.items():
        texts[(key[0], len(key[1]))].append(key)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for key in texts[(r["doc_id"], r["doc_tokens"])]:
            part = key[1][r["start"] : r["start"] + r["length"]]
            if zlib.crc32(np.array(part, dtype="<u4").tobytes()) == r["ids_crc32"]:
                by_key[key].append((r["start"], r["length"]))
                break
        else:
            raise AssertionError(r)
    assert set(by_key) == set(want)
    for key, parts in by_key.items():
        # Equal rows give equal pieces; each id is in as many as there are rows.
        cover = np.zeros(len(key[1]), int)
        for start, length in parts:
            assert length > 0
            cover[start : start + length] += 1
        assert (cover == want[key]).all()
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == tokens or (at < tokens and at & (at - 1) == 0)


def texts(seed, n, long=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    return [" ".join(rng.choices(words, k=max(0, int(rng.lognormvariate(3.5, 1.2))))) for _ in range(n)] + [
        " ".join(rng.choices(words, k=2000)) for _ in range(long)
    ]


@pytest.mark.parametrize(("tokens", "n", "long"), [(512, 700, 3), (128, 60, 1), (32, 40, 0), (4096, 3, 0), (64, 1, 0)])
def test_every_id_once_and_no_padding(spark, tokens, n, long):
    rows = [(i, t) for i, t in enumerate(texts(tokens, n, long))]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = lp.pack_lengths(df, tokenizer_path(), tokens=tokens, end_id=2)
    assert got.columns == lp.COLUMNS
    got = got.collect()
    checked(rows, got, tokens, 2)
    whole = sum(len(ids_of(t, 2)) for _, t in rows)
    sizes = Counter()
    for r in got:
        sizes[r["sequence_id"]] += r["length"]
    assert sum(sizes.values()) == whole and len(sizes) <= whole // tokens + tokens.bit_length()


def test_few_documents_are_cut(spark):
    rows = [(i, t) for i, t in enumerate(texts(5, 1500))]
    got = lp.pack_lengths(spark.createDataFrame(rows, DOCS), tokenizer_path(), tokens=1024).collect()
    pieces = Counter(r["doc_id"] for r in got)
    longer = {r["doc_id"] for r in got if r["doc_tokens"] > 1024}
    assert sum(1 for d, n in pieces.items() if n > 1 and d not in longer) <= 0.08 * len(rows)


def test_hot_length_and_odd_rows(spark, tmp_path):
    rows = [(i, "the same words again and again " * 20) for i in range(300)]
    rows += [(None, None), (None, ""), (1, "x"), (1, "x"), (1, " \n"), (2, "y " * 9000), (2, "y " * 9000)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as share", "'a' as row", "2 as length", "3 as bin")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op13_pack_lengths"](spark, str(tmp_path))
    assert [t for c, t in got.dtypes] == ["bigint"] * 7
    checked(rows, got.collect(), 4096, 2)


def test_no_rows(spark):
    assert lp.pack_lengths(spark.createDataFrame([], DOCS), tokenizer_path()).collect() == []


def test_not_a_power_of_two(spark):
    with pytest.raises(ValueError, match="power"):
        lp.pack_lengths(spark.createDataFrame([], DOCS), tokenizer_path(), tokens=1000)


@pytest.mark.parametrize("seed", range(6))
def test_least_squares_is_optimal(seed):
    rng = np.random.default_rng(seed)
    rows, n = 8, 40
    columns = [tuple(rng.integers(0, rows, rng.integers(1, 4)).tolist()) for _ in range(n)]
    target, weight = rng.integers(0, 50, rows).astype(float), rng.uniform(0.5, 3, rows)
    x = lp.least_squares(columns, target, weight)
    a = np.zeros((rows, n))
    for j, c in enumerate(columns):
        for r in c:
            a[r, j] += 1
    assert (x >= 0).all()
    gain = a.T @ (weight**2 * (target - a @ x))
    # No column could gain, and those in use have nothing to gain either way.
    assert gain.max() < 1e-6 * (1 + target.max()) and np.abs(gain[x > 0]).max(initial=0) < 1e-6 * (1 + target.max())


def test_bins_and_combinations(spark):
    tops = lp.bins(4096)
    assert tops[:64] == list(range(1, 65)) and tops[-1] == 4096 and len(tops) == 256
    df = spark.range(1, 4097).withColumnRenamed("id", "length")
    for r in lp._binned(df, 4096).collect():
        assert tops[r["bin"]] >= r["length"] > (tops[r["bin"] - 1] if r["bin"] else 0)
    found = lp.combinations(256)
    tops = lp.bins(256)
    assert len(found) == len(set(found))
    assert {w for w, _ in found} == {256, 128, 64}
    for window, names in found:
        assert window - window // 32 < sum(tops[b] for b in names) <= window
    # Every pair that fills the window to the last id is there.
    exact = {(256, p[::-1]) for p in itertools.combinations_with_replacement(range(len(tops)), 2) if tops[p[0]] + tops[p[1]] == 256 and tops[p[0]] >= 16}
    assert exact <= set(found)


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    tops = lp.bins(1024)
    counts = rng.integers(0, [3, 50, 2000, 40][seed], len(tops)) * (rng.random(len(tops)) < [1, 1, 0.3, 0.02][seed])
    held = np.zeros(len(tops), int)
    for window, times, each in lp.patterns(counts, 1024):
        assert times > 0 and sum(tops[b] * m for b, m in each) <= window and window & (window - 1) == 0
        for b, m in each:
            held[b] += times * m
    assert (held == counts).all()
