"""Running totals and lookups against brute force, with a hot group."""

import random

import pytest
from pyspark.sql import functions as F

import maskflow as mf
from maskflow.operators import prefix
from maskflow.operators import ranges as ranges_of
from maskflow.operators.prefix import lookup, running_totals
from maskflow.operators.ranges import Ranges
from maskflow.operators.vaults import unredact_with_vault


@pytest.fixture
def rows():
    rnd = random.Random(3)
    groups = ["hot"] * 400 + [f"g{rnd.randint(0, 60):02d}" for _ in range(600)]
    return [(g, i, rnd.randint(0, 9)) for i, g in enumerate(rnd.sample(groups, len(groups)))]


@pytest.mark.parametrize("parts", [None, 1, 2, 4, 37])
@pytest.mark.parametrize("group", [(), ("g",)])
def test_running_totals(spark, rows, parts, group):
    df = spark.createDataFrame(rows, "g string, o long, n long").repartition(7)
    out = running_totals(df, ["o"], {"before": "n"}, group=group, parts=parts).collect()
    sums, want = {}, {}
    for g, o, n in sorted(rows, key=lambda r: r[1]):
        key = g if group else None
        want[o] = sums.get(key, 0)
        sums[key] = want[o] + n
    assert {r.o: r.before for r in out} == want


def test_ranges_are_chosen_by_size(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix, "ROWS_PER_PART", 100)
    df = spark.createDataFrame(rows, "g string, o long, n long")
    out = running_totals(df, ["o"], {"before": "n"}, group=["g"])
    assert "_part" in out._jdf.queryExecution().analyzed().toString()
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[1])
    last = out.filter("g = 'hot'").orderBy(F.desc("o")).first()
    assert last.before == sum(r[2] for r in hot[:-1])


@pytest.mark.parametrize("hot_rows", [1, 7, 1_000_000])
def test_lookup(spark, rows, hot_rows):
    left = spark.createDataFrame(rows, "g string, o long, n long")
    table = spark.createDataFrame([("hot", "H"), ("g01", "one")], "g string, v string")
    out = lookup(left, table, ["g"], ["o"], hot_rows=hot_rows).collect()
    names = {"hot": "H", "g01": "one"}
    assert sorted((r.g, r.o, r.n, r.v or "") for r in out) == sorted(
        (*r, names.get(r[0], "")) for r in rows
    )


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_vault_restores_many_answers_to_one_request(spark, hot_rows):
    vault = spark.createDataFrame(
        [(1, "US_SSN_0001", "856-45-6789"), (2, "US_SSN_0001", "$1\\")],
        "request_num long, placeholder string, original string",
    )
    answers = spark.createDataFrame(
        [(i, 1 if i % 3 else 2, "US_SSN_0001 US_SSN_0002, US_SSN_0001") for i in range(20)]
        + [(20, 1, "none"), (21, 1, None)],
        "a long, request_num long, t string",
    )
    out = unredact_with_vault(answers, vault, "a", "t", ["request_num"], hot_rows=hot_rows)
    got = {r.a: r.restored for r in out.collect()}
    for i in range(20):
        v = "856-45-6789" if i % 3 else "$1\\"
        assert got[i] == f"{v} US_SSN_0002, {v}"
    assert (got[20], got[21]) == ("none", None)


def test_answers_without_placeholders_are_not_shuffled(spark, tmp_path):
    vault = spark.createDataFrame([(1, "US_SSN_0001", "856-45-6789")], "r long, placeholder string, original string")
    rows = [(i, 1, "plain text" if i % 4 else "US_SSN_0001") for i in range(40)]
    spark.createDataFrame(rows, "a long, r long, t string").write.parquet(str(tmp_path / "answers"))
    out = unredact_with_vault(spark.read.parquet(str(tmp_path / "answers")), vault, "a", "t", ["r"])
    assert {r.a: r.restored for r in out.collect()} == {i: "plain text" if i % 4 else "856-45-6789" for i in range(40)}
    union = out._jdf.queryExecution().sparkPlan()
    plain = union.children().apply(1).toString()
    assert "Join" not in plain and "Exchange" not in plain and "RLIKE" in plain.upper()


@pytest.mark.parametrize("parts", [None, 1, 3, 40])
def test_hot_key_is_dealt_to_many_ranges(spark, parts):
    rnd = random.Random(7)
    keys = ["m"] * 900 + [rnd.choice("abcxyz") for _ in range(100)]
    rnd.shuffle(keys)
    df = spark.createDataFrame([(k, f"text {i}") for i, k in enumerate(keys)], "k string, t string").repartition(6)
    out = mf.number_requests(df, "k", parts)
    assert out.columns == ["k", "t", "request_num"]
    rows = sorted(out.collect(), key=lambda r: r.request_num)
    assert [r.request_num for r in rows] == list(range(1, 1001))
    assert [r.k for r in rows] == sorted(keys) and {r.t for r in rows} == {f"text {i}" for i in range(1000)}
    ranges = Ranges(df, "k", 40)
    sizes = df.groupBy(ranges.number(F.xxhash64("k", "t")).alias("r")).count().collect()
    assert len(sizes) >= 30 and max(r["count"] for r in sizes) < 100


@pytest.mark.parametrize("sample", [16_384, 64])
def test_sketch_bounds_and_rows(spark, monkeypatch, sample):
    monkeypatch.setattr(ranges_of, "SAMPLE", sample)
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"))
    keys, rows = ranges_of.sketch(df, "k")
    assert len(keys) == min(sample, 5000) and keys == sorted(keys) and 0.5 * 5000 < rows < 2 * 5000
    ranges = Ranges(df, "k", 16)
    got = df.select("k", ranges.number().alias("r")).collect()
    assert all(r.r == sum(b <= r.k for b in ranges.bounds) for r in got)
    assert ranges.count == 16 and len({r.r for r in got}) == 16


def test_ranges_of_no_rows_and_one_key(spark):
    none = spark.createDataFrame([], "k long, t string")
    assert mf.number_requests(none, "k").collect() == []
    one = spark.createDataFrame([(1, {"a": "b"})] * 3, "k long, m map<string,string>")
    assert sorted(r.request_num for r in mf.number_requests(one, "k").collect()) == [1, 2, 3]
