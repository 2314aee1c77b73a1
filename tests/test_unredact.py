"""Restoring: literals."""

import time

import pytest
from pyspark.sql import functions as F

import maskflow as mf
from maskflow.functions import restore as R
from maskflow.functions.restore import Restorer

ALL = {"US_SSN_0001": "123-45-6789", "EMAIL_ADDRESS_0001": "john@example.com", "PHONE_NUMBER_0001": "555-123-4567"}
LETTER = "Dear US_SSN_0001,\n\n    Your email EMAIL_ADDRESS_0001 is fine.\n\n    Call PHONE_NUMBER_0001."


@pytest.mark.parametrize(
    "text, mapping, want",
    [
        ("My SSN is US_SSN_0001", ALL, "My SSN is 123-45-6789"),
        ("to EMAIL_ADDRESS_0001 CC EMAIL_ADDRESS_0001", ALL, "to john@example.com CC john@example.com"),
        (LETTER, ALL, "Dear 123-45-6789,\n\n    Your email john@example.com is fine.\n\n    Call 555-123-4567."),
        ("no placeholder", ALL, "no placeholder"),
        ("", ALL, ""),
        (None, ALL, None),
        ("US_SSN_0001", {}, "US_SSN_0001"),
        ("US_SSN_0001", None, "US_SSN_0001"),
        ("EMAIL_ADDRESS_0002", ALL, "EMAIL_ADDRESS_0002"),
        ("is EMAIL_ADDRESS_0001", {"EMAIL_ADDRESS_0001": "user+tag@$1\\.com"}, "is user+tag@$1\\.com"),
    ],
)
def test_literals(spark, text, mapping, want):
    df = spark.createDataFrame([(text, mapping)], "t string, m map<string,string>")
    row = df.select(mf.unredact(F.col("t"), F.col("m")), mf.unredact_tokens(F.col("t"), F.col("m"))).first()
    assert row[0] == row[1] == want


@pytest.mark.parametrize(
    "text, mapping, want",
    [
        ("US_SSN_00012", {"US_SSN_0001": "x"}, "US_SSN_00012"),
        ("EMAIL_ADDRESS_10000 EMAIL_ADDRESS_1000", {"EMAIL_ADDRESS_1000": "a", "EMAIL_ADDRESS_10000": "b"}, "b a"),
        ("MYUS_SSN_0001 US_SSN_EMAIL_ADDRESS_0001", {"US_SSN_0001": "x", "EMAIL_ADDRESS_0001": "y"}, "MYx US_SSN_y"),
        ("TAX_ID_0001 ID_0001", {"ID_0001": "i", "TAX_ID_0001": "t"}, "t i"),
        ("A_0001B_0001", {"A_0001": "B_0001", "B_0001": "z"}, "B_0001z"),
        ("_0001 __0001 A_B_0001é", {"_0001": "x", "A_B_0001": "$0"}, "x _x $0é"),
    ],
)
def test_whole_tokens(spark, text, mapping, want):
    """Never inside a longer number, the longest placeholder, nothing read twice."""
    df = spark.createDataFrame([(text, mapping)], "t string, m map<string,string>")
    row = df.select(mf.unredact(F.col("t"), F.col("m")), mf.unredact_tokens(F.col("t"), F.col("m"))).first()
    assert row[0] == row[1] == want == Restorer(mapping).restore(text)


def test_other_keys_are_replaced_literally(spark):
    df = spark.createDataFrame([("name is {n}, US_SSN_0001", {"{n}": "Jo", "US_SSN_0001": "856"})], "t string, m map<string,string>")
    assert df.select(mf.unredact(F.col("t"), F.col("m"))).first()[0] == "name is Jo, 856"


def test_only_some_entities(spark):
    df = spark.createDataFrame([("US_SSN_0001 EMAIL_ADDRESS_0001", ALL)], "t string, m map<string,string>")
    assert df.select(mf.unredact_tokens(F.col("t"), F.col("m"), ["US_SSN"])).first()[0] == "123-45-6789 EMAIL_ADDRESS_0001"


def test_long_runs_of_letters_are_linear(spark):
    df = spark.range(1).select(F.expr("repeat('A_', 1000000)").alias("t"), F.expr("map('US_SSN_0001', 'x')").alias("m"))
    text = F.concat("t", F.lit("_0001 US_SSN_0001 "), "t", F.lit("_000"))
    began = time.perf_counter()
    assert df.select(F.length(mf.unredact(text, F.col("m")))).first()[0] == 4_000_000 + 5 + 3 + 4
    assert time.perf_counter() - began < 20


def test_holdback_length(spark):
    df = spark.createDataFrame([(ALL,), ({},), (None,)], "m map<string,string>")
    assert [r[0] for r in df.select(mf.holdback_length(F.col("m"))).collect()] == [18, 0, 0]


@pytest.mark.parametrize("n", [0, 1, R.FEW - 1, R.FEW, R.FEW + 1, 200])
def test_few_entries_are_looked_at_and_many_searched(spark, n):
    mapping = {f"US_SSN_{i:04d}": f"<{i}>" for i in range(1, n + 1)}
    text = " ".join(f"US_SSN_{i:04d}" for i in range(0, n + 2))
    rows = spark.createDataFrame([(mapping, text)], "m map<string,string>, t string")
    known = R.prepare(R._pairs(F.col("m")), R.type_names(F.map_keys("m")))
    got = rows.select(R.unredact_tokens(F.col("t"), F.col("m")).alias("t"), F.size(known["steps"]).alias("steps")).first()
    assert got["t"] == " ".join(mapping.get(k, k) for k in text.split(" "))
    # Steps are for a search; few entries need none.
    assert (got["steps"] == 0) == (n <= R.FEW)
