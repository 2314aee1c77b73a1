"""Runs of words against plain Python."""

import hashlib
import random
import time
import zlib

import pytest

from maskflow.llm import periodic, queries

WORD = b" \t\n\x0b\x0c\r"


def brute_runs(w, least=12):
    """Every stretch of at least two periods that no neighbour extends, period by period."""
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            part = w[i : i + length]
            if length >= max(least, 2 * p) and not any(part[q:] == part[: len(part) - q] for q in range(1, p)):
                out.append((i, length, p))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefgh"])
def test_all_runs_of_random_words(letters):
    rng = random.Random(len(letters))
    for n in [0, 1, 2, 3, 5, 8, 13, 21, 40, 70] * 6:
        w = [rng.choice(letters) for _ in range(n)]
        if n > 20 and rng.random() < 0.5:
            p = rng.randint(1, n // 3)
            w = [w[i % p] for i in range(n - 3)] + w[-3:]
        assert [(s, length, p) for s, p, length in sorted((s, p, x) for s, x, p in periodic.runs_of(w).tolist())] == brute_runs(w, 2)


def test_fibonacci_words():
    a, b = "b", "a"
    for _ in range(11):
        a, b = b, b + a
    assert sorted(periodic.runs_of(list(b)).tolist()) == sorted(map(list, brute_runs(list(b), 2)))


def test_stretches_lose_no_run():
    rng = random.Random(8)
    for _ in range(300):
        w = []
        while len(w) < 120:
            block = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 12))]
            w += (block * rng.choice([1, 1, 2, 3, 7]))[: rng.randint(1, 60)]
        found = [r for _, runs, _ in periodic._find([" ".join(w).encode()]) for r in runs]
        assert [(r["start"], r["length"], r["period"]) for r in found] == brute_runs(w)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, "a " * 30), (None, None), (0, None), (1, ""), (2, " \n\t "), (3, "x " * 12), (3, "x " * 12), (4, "x " * 11)]
    rows += [(-7, "a b\tc d\n" * 9), (5, "é ü " * 8 + "\x0bz")]
    for i in range(200):
        text = [rng.choice("abc") if rng.random() < 0.3 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(150))]
        if rng.random() < 0.3:
            text += text[-rng.randint(1, 40) :] * rng.randint(1, 4)
        rows.append((100 + i, rng.choice([" ", "  ", "\n"]).join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as start", "'x' as w")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute(*r) for r in rows), key=repr)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect() == []


def test_long_texts():
    rng = random.Random(1)
    words = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    words[20_000:40_000] = (words[20_000:20_700] * 30)[:20_000]
    words += ["a", "b"] * 5_000
    began = time.perf_counter()
    ((n, runs, kept),) = periodic._find([" ".join(words).encode()])
    assert time.perf_counter() - began < 20
    assert n == 70_000 and {(r["start"], r["period"]) for r in runs} == {(20_000, 700), (60_000, 2)}
    assert len(kept.split()) == 60_000 - 20_000 + 700 + 2
