"""Inputs that once gave wrong answers or took too long."""

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import maskflow as mf
from maskflow.functions import detect as D
from maskflow.operators import holdback as H


@pytest.mark.parametrize("separators", [1, 8, 50, 1000, 1001, 5000, 2_000_000])
def test_runs_of_two_megabytes_take_linear_time(spark, separators):
    run = ("a" + "." * separators) * max(1, 2_000_000 // (separators + 1))
    df = spark.createDataFrame([(run + " x@y.zz",)], "t string").cache()
    df.select(D.hit_values(F.col("t"))).first()
    start = time.perf_counter()
    assert df.select(D.hit_values(F.col("t"))).first()[0] == ["x@y.zz"]
    assert time.perf_counter() - start < 2


@pytest.mark.parametrize("unit", ["+", "a+", "+1", "@", ".@", "a@.", "+1 ", "a@b.", "-1-"])
def test_other_runs_take_linear_time(spark, unit):
    df = spark.createDataFrame([(unit * (1_000_000 // len(unit)) + " x@y.zz",)], "t string").cache()
    df.select(D.hit_values(F.col("t"))).first()
    start = time.perf_counter()
    assert df.select(D.hit_values(F.col("t"))).first()[0][-1] == "x@y.zz"
    assert time.perf_counter() - start < 3


def test_repeated_and_null_keys(spark):
    keys = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("b",)], "k string")
    rows = sorted(tuple(r) for r in mf.number_requests(keys, "k").collect())
    assert rows == [("a", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 5)]
    with pytest.raises(ValueError, match="null"):
        mf.number_requests(keys.union(spark.createDataFrame([(None,)], "k string")), "k")
    for repeated in ([(1, "a@b.cc"), (1, "c@d.ee")], [(None, "a@b.cc"), (2, "c@d.ee")]):
        docs = spark.createDataFrame(repeated, "k long, t string")
        with pytest.raises(PySparkException, match="unique"):
            mf.mask_column(docs, "k", "t").collect()


@pytest.mark.parametrize("entries", [64, 65, 200])
def test_restored_chunks_do_not_depend_on_the_size_of_the_mapping(spark, entries):
    mapping = {"EMAIL_ADDRESS_0001": "0002x@y.com", "EMAIL_ADDRESS_0002": "second@z.org"}
    mapping |= {f"US_SSN_{i:04d}": f"856-45-{i:04d}" for i in range(1, entries - 1)}
    chunks = spark.createDataFrame(
        [(1, 0, "go EMAIL_ADDRESS_EMAIL_ADDRESS_0001 end " + "pad " * 20)], "request_id long, seq long, content string"
    )
    maps = spark.createDataFrame([(1, mapping)], "request_id long, mapping map<string,string>")
    rows = mf.release_chunks(chunks, maps).collect()
    text = "".join(r.content for r in sorted(rows, key=lambda r: (r.seq is None, r.seq)))
    assert text.startswith("go EMAIL_ADDRESS_0002x@y.com end")  # what was put in is not read again


def test_answers_of_any_length_are_one_row(spark):
    chunks = [(1, i, "x" * 1000) for i in range(2000)] + [(2, 0, ""), (3, 0, None), (5, 0, "no map")]
    chunks = spark.createDataFrame(chunks, "request_id long, seq long, content string")
    maps = [(i, {"US_SSN_0001": "1"}) for i in (1, 2, 3, 4)]
    maps = spark.createDataFrame(maps, "request_id long, mapping map<string,string>")
    got = {r.request_id: r.final_response for r in mf.full_answers(chunks, maps).collect()}
    assert got == {1: "x" * 2_000_000, 2: "", 3: "", 4: "", 5: "no map"}


def test_ranges_of_one_answer_are_dealt_apart(spark):
    chunks = spark.createDataFrame([(1, i, "x" * 50) for i in range(2000)], "request_id long, seq long, content string")
    maps = spark.createDataFrame([(1, {"US_SSN_0001": "1"})], "request_id long, mapping map<string,string>")
    plan = mf.release_chunks(chunks, maps)._jdf.queryExecution().toString()
    # Texts are dealt by request and range; only their last characters by request.
    assert "hashpartitioning(request_id" in plan and "Window [collect_list(end" in plan
    rows = H._texts(chunks, maps)
    assert rows.count() == -(-2000 // H.RANGE) and rows.agg(F.max(F.size("pieces"))).first()[0] == H.RANGE


def _stream(spark, folder, header, row, out, columns=None):
    (folder / "in").mkdir()
    (folder / "in" / "a.csv").write_text(f"{header}\n{row}\n")
    rows = mf.read_requests_stream(spark, str(folder / "in"), columns)
    query = rows.writeStream.format("memory").queryName(out).trigger(availableNow=True).start()
    query.awaitTermination()
    return [tuple(r) for r in spark.table(out).collect()]


def test_stream_columns_by_name(spark, tmp_path):
    got = _stream(spark, tmp_path, "prompt,tenant,request_num,system_prompt", "hello,t1,7,be kind", "by_name")
    assert got == [(7, "be kind", "hello")]
    with pytest.raises(ValueError):
        mf.read_requests_stream(spark, str(tmp_path / "in"), ["prompt", "system_prompt"])


def test_stream_with_another_header_or_no_number_stops(spark, tmp_path):
    with pytest.raises(PySparkException):
        _stream(spark, tmp_path, "request_num,tenant,system_prompt,prompt", "1,t,s,p", "other", ["request_num", "system_prompt", "prompt", "tenant"])
    (tmp_path / "b").mkdir()
    with pytest.raises(PySparkException):
        _stream(spark, tmp_path / "b", "request_num,system_prompt,prompt", "x,s,p", "numberless")
