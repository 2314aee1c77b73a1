"""CSV sources, completion, result records."""

import csv
import random

import pytest
from pyspark.sql import functions as F

import maskflow as mf
from maskflow.operators import completion as C
from maskflow.sources import requests as S


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def echo(model):
    return lambda system, user: f"{system}|{user}"


def test_read_requests(spark, tmp_path):
    path = write(
        tmp_path / "r.csv",
        'extra,system_prompt,prompt\n1,"You, are","Email ""a"" b@c.org"\n2,,007\n3,NA,"two\nlines"\n4,x,None\n',
    )
    rows = mf.read_requests(spark, path).orderBy("request_num").collect()
    assert [tuple(r) for r in rows] == [
        (1, "You, are", 'Email "a" b@c.org'),
        (2, "", "007"),
        (3, "", "two\nlines"),
        (4, "x", ""),
    ]


@pytest.mark.parametrize("multi_line", [True, False])
def test_numbers_follow_file_order(spark, tmp_path, monkeypatch, multi_line):
    n = 0
    for f, rows in enumerate([300, 1, 0, 40]):
        body = "".join(f"s{n + i},p{n + i}\n" for i in range(rows))
        write(tmp_path / f"part-{f}.csv", "system_prompt,prompt\n" + body)
        n += rows
    conf = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(conf, "700")
    try:
        for limit in (100_000, 0):
            monkeypatch.setattr(S, "_BROADCAST_SPLITS", limit)
            df = mf.read_requests(spark, str(tmp_path), multi_line)
            rows = df.collect()
            assert sorted(r.request_num for r in rows) == list(range(1, n + 1))
            assert all(r.prompt == f"p{r.request_num - 1}" for r in rows)
    finally:
        spark.conf.unset(conf)


def test_bad_files(spark, tmp_path):
    for header in ("wrong_column,another_wrong", "prompt", "system_prompt,other"):
        with pytest.raises(ValueError, match="system_prompt.*prompt"):
            mf.read_requests(spark, write(tmp_path / f"{len(header)}.csv", f"{header}\nx,y\n"))
    assert mf.read_requests(spark, write(tmp_path / "e.csv", "system_prompt,prompt\n")).count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        mf.read_requests(spark, str(tmp_path / "missing.csv"))


def test_number_requests(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",)], "k string")
    for parts in (None, 2):
        rows = mf.number_requests(df, "k", parts).collect()
        assert {r.k: r.request_num for r in rows} == {"a": 1, "b": 2, "c": 3}


def requests(spark):
    return spark.createDataFrame(
        [
            (1, "You are a helpful assistant.", "Please email john@example.com"),
            (2, "Client SSN: 856-45-6789", "My email is jane@example.org and phone is 555-123-4567"),
            (3, "You are a helpful assistant.", "Hello"),
        ],
        "request_num long, system_prompt string, prompt string",
    )


def test_process_requests(spark):
    rows = mf.process_requests(requests(spark), echo).orderBy("request_num").collect()
    assert [r.redacted_user for r in rows] == [
        "Please email EMAIL_ADDRESS_0001",
        "My email is EMAIL_ADDRESS_0002 and phone is PHONE_NUMBER_0001",
        "Hello",
    ]
    assert rows[1].mappings == {
        "US_SSN_0001": "856-45-6789",
        "PHONE_NUMBER_0001": "555-123-4567",
        "EMAIL_ADDRESS_0002": "jane@example.org",
    }
    for r in rows:
        assert r.final_response == f"{r.original_system}|{r.original_user}"
        assert r.llm_response_redacted == f"{r.redacted_system}|{r.redacted_user}"
        assert r.error is None


def test_model_sees_masked_texts_only(spark):
    def spy(model):
        def complete(system, user):
            assert "@" not in user and "856" not in system
            return model

        return complete

    rows = mf.process_requests(requests(spark), spy, model="m1").collect()
    assert [(r.llm_response_redacted, r.error) for r in rows] == [("m1", None)] * 3


def test_one_failure_leaves_the_others(spark):
    def connect(model):
        def complete(system, user):
            if user.startswith("Please"):
                raise ValueError("API rate limit exceeded")
            return None if user == "Hello" else user

        return complete

    rows = mf.process_requests(requests(spark), connect).orderBy("request_num").collect()
    assert rows[0].error == C.CALL_FAILED + "API rate limit exceeded"
    assert rows[0].original_user == "Please email john@example.com"
    assert rows[0][3:8] == (None,) * 5
    # Its number is used up, and a null answer is a success.
    assert "EMAIL_ADDRESS_0002" in rows[1].redacted_user
    assert (rows[2].final_response, rows[2].error) == (None, None)
    results = mf.process_requests(requests(spark), connect)
    assert tuple(mf.summarize(results).first()) == (3, 2, 1)


def test_recorded_answers(spark):
    answers = spark.createDataFrame(
        [(1, "to EMAIL_ADDRESS_0001 EMAIL_ADDRESS_0007", None), (2, None, "API timeout")],
        "request_num long, response string, error string",
    )
    rows = mf.process_requests(requests(spark), responses=answers).orderBy("request_num").collect()
    assert rows[0].final_response == "to john@example.com EMAIL_ADDRESS_0007"
    assert [r.error for r in rows] == [None, "API timeout", C.NO_ANSWER]
    with pytest.raises(ValueError):
        mf.process_requests(requests(spark))


def test_calls_are_made_once(spark, tmp_path):
    log = str(tmp_path)

    def connect(model):
        import uuid
        from pathlib import Path

        def complete(system, user):
            Path(log, uuid.uuid4().hex).touch()
            return user

        return complete

    results = mf.process_requests(requests(spark), connect)
    assert results.count() == len(results.collect()) == len(list(tmp_path.iterdir())) == 3


def test_session_goes_on_over_files(spark, tmp_path):
    session = mf.Session(echo)
    for i in (1, 2):
        path = write(tmp_path / f"{i}.csv", f"system_prompt,prompt\ns,mail m{i}@example.com\n")
        row = session.process_csv(spark, path).first()
        assert row.redacted_user == f"mail EMAIL_ADDRESS_000{i}"
        assert row.final_response == f"s|mail m{i}@example.com"


def test_preview(spark):
    df = requests(spark).withColumn("prompt", F.concat("prompt", F.repeat(F.lit("é"), F.lit(200))))
    row = mf.preview(mf.process_requests(df, echo)).filter("request_num = 3").first()
    assert row.original_user == "Hello" + "é" * 95 + "..."
    assert row.original_system == "You are a helpful assistant."
    assert (row.has_pii, row.mapping_lines) == (False, "")


def test_sinks_keep_originals_out(spark, tmp_path):
    results = mf.process_requests(requests(spark), echo)
    mf.write_results(results, str(tmp_path / "out"))
    columns = spark.read.parquet(str(tmp_path / "out")).columns
    assert columns == ["request_num", "redacted_system", "redacted_user", "llm_response_redacted", "error"]
    mf.write_results(results, str(tmp_path / "all"), keep_originals=True)
    assert len(spark.read.parquet(str(tmp_path / "all")).columns) == 9


def test_shared_folder_is_required_on_a_cluster():
    from maskflow import session

    class Session:
        def __init__(self, **settings):
            self.conf = {k.replace("_", "."): v for k, v in settings.items()}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session(spark_master="yarn"))
    assert session.shared_dir(Session(spark_checkpoint_dir="s3a://b/c/")) == "s3a://b/c"
    local = session.shared_dir(Session(spark_master="local[2]"))
    assert local == session.shared_dir(Session(spark_master="local[2]"))


def test_nothing_to_do(spark, tmp_path):
    path = write(tmp_path / "e.csv", "system_prompt,prompt\n")
    results = mf.process_csv(spark, path, echo)
    assert results.count() == 0
    assert tuple(mf.summarize(results).first()) == (0, 0, 0)
    clean = requests(spark).filter("request_num = 3")
    for parts in (None, 3):
        row = mf.mask_requests(clean, "session", parts=parts).first()
        assert (row.redacted_user, row.mappings) == ("Hello", {})
    none = spark.createDataFrame([], "request_id long, seq long, content string")
    maps = spark.createDataFrame([], "request_id long, mapping map<string,string>")
    assert mf.release_chunks(none, maps).count() == mf.full_answers(none, maps).count() == 0


@pytest.mark.parametrize("block", [200, 1500, 10_000_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_in_many_tasks(spark, tmp_path, block, end):
    rnd = random.Random(block)
    cells = ["a", "", 'say "hi"', "two\nlines", "\n\n", ",", "é\n\"\n", "NA", "x" * 150 + "\n" + "y" * 250, " ", '"']
    for f, n in enumerate([120, 1, 0, 40]):
        with open(tmp_path / f"part-{f}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(["id", "system_prompt", "prompt"])
            for i in range(n):
                writer.writerow([f"{f}-{i}", rnd.choice(cells), rnd.choice(cells)])
                if i % 9 == 0:
                    out.write(end)
    want = mf.read_requests(spark, str(tmp_path)).orderBy("request_num").collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        rows = mf.read_requests(spark, str(tmp_path), multi_line="split")
        got = rows.orderBy("request_num").collect()
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows.columns == ["request_num", "system_prompt", "prompt"] and len(want) == 161
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert (tasks > 5) == (block < 10_000)
