"""Streams: any arrival order, duplicates, restarts, errors, timeouts."""

import json
import random
import time

import pyarrow as pa
import pytest

import maskflow as mf
from maskflow.streaming import events as E
from maskflow.streaming import sinks as W
from tests.test_holdback import LITERALS, cases, model


def tagged_rows(many, broken=()):
    rows = []
    for i, (chunks, mapping) in enumerate(many):
        opened = {"original_user": f"u{i}", "redacted_user": "r", "mappings": mapping}
        rows.append((i, "open", -1, json.dumps(opened)))
        rows += [(i, "chunk", k, c) for k, c in enumerate(chunks)]
        last = ("error", "boom") if i in broken else ("end", None)
        rows.append((i, last[0], len(chunks), last[1]))
    return rows


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, E.TAGGED).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, tmp_path):
    stream = spark.readStream.schema(E.TAGGED).option("maxFilesPerTrigger", 2).parquet(folder)
    query = W.write_stream(mf.restore_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()


def read(spark, tmp_path):
    rows = spark.read.schema(E.EVENTS).parquet(str(tmp_path / "out")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.request_num, r.event_seq)):
        by.setdefault(r.request_num, []).append(r)
    return by


def check(by, many, broken=()):
    assert len(by) == len(many)
    for i, (chunks, mapping) in enumerate(many):
        events = by[i]
        assert [e.event_seq for e in events] == list(range(len(events)))
        assert events[0].type == "metadata" and events[0].mappings == mapping
        out, rest = model(chunks, mapping)
        want = [(k, c) for k, c in enumerate(out) if c]
        if i in broken:
            assert (events[-1].type, events[-1].error, events[-1].original_user) == ("error", "boom", f"u{i}")
        else:
            want += [(None, rest)] if rest else []
            assert events[-1].type == "final"
            assert events[-1].llm_response_redacted == "".join(chunks)
            assert events[-1].final_response == "".join(out) + rest
        assert [(e.chunk_seq, e.content) for e in events[1:-1]] == want


def test_any_order_duplicates_and_restart(spark, tmp_path):
    many = LITERALS + cases(25, 20, 12)
    rows = tagged_rows(many, broken={1, 20})
    rnd = random.Random(1)
    opens = [r for r in rows if r[1] == "open"]
    repeats = [r for r in rnd.sample(rows, 40) if r[1] == "chunk"]
    shuffled = rows + repeats
    rnd.shuffle(shuffled)
    # Repeats must come while their request is still open.
    late = [r for r in shuffled if r[1] in ("end", "error")]
    early = [r for r in shuffled if r[1] not in ("end", "error")]
    folder = str(tmp_path / "in")
    for part in (early[::3], early[1::3]):
        arrive(spark, folder, part)
    run(spark, folder, tmp_path)
    for part in (early[2::3], opens[:5] + late):
        arrive(spark, folder, part)
    run(spark, folder, tmp_path)
    check(read(spark, tmp_path), many, broken={1, 20})


def test_final_text_can_stay_out_of_the_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, tagged_rows(LITERALS[:2]))
    stream = spark.readStream.schema(E.TAGGED).parquet(folder)
    events = mf.restore_stream(stream, keep_final=False)
    W.write_stream(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    by = read(spark, tmp_path)
    assert by[1][-1].type == "final" and by[1][-1].final_response is None
    assert "".join(e.content or "" for e in by[1]) == "Contact us at john@example.com please"


def test_two_sinks(spark, tmp_path):
    folder, out, vault = (str(tmp_path / p) for p in ("in", "out", "vault"))
    arrive(spark, folder, tagged_rows(LITERALS))
    events = mf.restore_stream(spark.readStream.schema(E.TAGGED).parquet(folder))
    W.write_event_stream(events, out, str(tmp_path / "cp"), vault).awaitTermination()
    rows = spark.read.parquet(out)
    assert not {"original_user", "mappings"} & set(rows.columns)
    assert rows.filter("type = 'final'").count() == len(LITERALS)
    kept = spark.read.parquet(vault).filter("request_num = 9").orderBy("ord").collect()
    assert [(r.placeholder, r.original) for r in kept] == [("A_0001", "X"), ("B_0001", "Y"), ("C_0001", "Z")]


def test_readers_see_both_tables_of_a_batch_or_neither(spark, tmp_path):
    out, vault = str(tmp_path / "out"), str(tmp_path / "vault")
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id long, name string")

    def fails():
        raise RuntimeError("lost")

    with pytest.raises(FileNotFoundError):
        W.read_committed(spark, out)
    W._write_batch(out, 0, {out: lambda: rows, vault: lambda: rows.select("id")})
    with pytest.raises(RuntimeError):
        W._write_batch(out, 1, {out: lambda: rows, vault: fails})
    assert spark.read.parquet(out).count() == 10  # the first table of the failed attempt is there
    assert W.read_committed(spark, out).count() == W.read_committed(spark, out, vault).count() == 5
    for _ in range(2):  # done again, and replayed once more
        W._write_batch(out, 1, {out: lambda: rows, vault: lambda: rows.select("id")})
    for table in (None, vault):
        got = W.read_committed(spark, out, table)
        assert sorted((r.batch, r.id) for r in got.collect()) == [(b, i) for b in (0, 1) for i in range(5)]


def test_abandoned_request_times_out(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, tagged_rows(LITERALS[1:2])[:-1])
    events = mf.restore_stream(spark.readStream.schema(E.TAGGED).parquet(folder), timeout_ms=500)
    query = W.write_stream(events, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=False)
    try:
        for _ in range(60):
            time.sleep(1)
            done = (tmp_path / "out").exists() and read(spark, tmp_path)
            if done and done[0][-1].type == "error":
                break
    finally:
        query.stop()
    assert done[0][-1].error == E.TIMED_OUT
    assert "".join(e.content or "" for e in done[0]) == "Contact us at "


def test_requests_to_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(
        "request_num,system_prompt,prompt\n"
        "1,Client SSN: 856-45-6789,My email is john@example.com and phone is 555-123-4567\n"
        "2,,Hello\n3,fail,mail alice@example.com\n"
    )

    def connect(model):
        def stream(system, user):
            if system == "fail":
                raise RuntimeError("API error")
            yield from ["Dear ", "US_SSN_", "0001, ", "", "EMAIL_ADDRESS_", "0001 or PHONE_", "NUMBER_0001."]

        return stream

    requests = mf.read_requests_stream(spark, str(tmp_path / "in"))
    events = mf.process_requests_stream(requests, connect)
    W.write_stream(events, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    by = read(spark, tmp_path)
    text = "Dear 856-45-6789, john@example.com or 555-123-4567."
    assert by[1][-1].final_response == text == "".join(e.content or "" for e in by[1])
    assert by[1][0].mappings["PHONE_NUMBER_0001"] == "555-123-4567"
    assert by[2][0].mappings == {} and by[2][-1].final_response.startswith("Dear US_SSN_0001")
    assert [e.type for e in by[3]] == ["metadata", "error"]
    assert by[3][-1].error.endswith("API error") and by[3][-1].original_user == "mail alice@example.com"
    out = spark.read.schema(E.EVENTS).parquet(str(tmp_path / "out"))
    assert tuple(mf.stream_summary(out).first()) == (3, 2, 1)


def test_session_numbers_over_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    paths = [str(tmp_path / p) for p in ("in", "out", "cp", "vault")]
    for i in (1, 2):
        (tmp_path / "in" / f"{i}.csv").write_text(
            f"request_num,system_prompt,prompt\n{i},s,a{i}@b.com and c{i}@d.com\n"
        )
        stream = mf.read_requests_stream(spark, paths[0])
        W.write_masked_session_stream(stream, paths[1], paths[2], paths[3]).awaitTermination()
    rows = spark.read.parquet(paths[1]).orderBy("request_num").collect()
    assert [r.redacted_user for r in rows] == [
        "EMAIL_ADDRESS_0002 and EMAIL_ADDRESS_0001",
        "EMAIL_ADDRESS_0004 and EMAIL_ADDRESS_0003",
    ]
    assert "original_user" not in rows[0].asDict()
    assert spark.read.parquet(paths[3]).count() == 4


@pytest.mark.parametrize("column", ["system_prompt", "prompt"])
def test_stream_needs_its_columns(spark, tmp_path, column):
    with pytest.raises(ValueError):
        mf.read_requests_stream(spark, str(tmp_path), ["request_num", column])


class _Kept:
    """A state variable that counts the characters written to it."""

    def __init__(self):
        self.value, self.list, self.map, self.written, self.read = None, [], {}, [], []

    def exists(self):
        return self.value is not None or bool(self.list) or bool(self.map)

    def clear(self):
        self.value, self.list, self.map = None, [], {}

    def get(self):
        return self.value if not self.list else iter(self.list)

    def update(self, value):
        self.value = value
        self.written.append(len(str(value)))

    def appendValue(self, value):  # noqa: N802
        self.list.append(value)
        self.written.append(len(str(value)))

    def getValue(self, key):  # noqa: N802
        self.read.append(key)
        return self.map.get(key)

    def containsKey(self, key):  # noqa: N802
        return key in self.map

    def updateValue(self, key, value):  # noqa: N802
        self.map[key] = value
        self.written.append(len(str(value)))

    def removeKey(self, key):  # noqa: N802
        del self.map[key]


class _Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, _Kept())

    getListState = getMapState = getValueState


def test_what_a_micro_batch_writes_does_not_grow_with_the_answer():
    handle, processor = _Handle(), E._Restoring(True, None, True)
    processor.init(handle)
    mapping = {f"US_SSN_{i:04d}": f"<{i}>" for i in range(1, 2001)}
    opened = json.dumps({"original_user": "u" * 5000, "mappings": mapping})
    row = lambda kind, seq, content: {"kind": kind, "seq": seq, "content": content}
    list(processor.handleInputRows((1,), [row("open", -1, opened)], None))
    given, shown = [], []
    for batch in range(300):
        rows = [row("chunk", 2 * batch + i, f"{'word ' * 20}US_SSN_{batch + 1:04d} ") for i in (1, 0)]
        given += [r["content"] for r in reversed(rows)]
        shown += [e["content"] for e in processor.handleInputRows((1,), rows, None)]
    states = handle.states
    assert max(states["place"].written) < 100 and max(states["answer"].written) < 300
    assert len(states["originals"].written) == len(states["facts"].written) == 1
    assert len(states["entries"].written) == 2000 and len(states["entries"].read) <= 2 * 300
    *rest, final = processor.handleInputRows((1,), [row("end", 600, None)], None)
    want = "".join(given)
    for key, value in mapping.items():
        want = want.replace(key, value)
    assert "".join([*shown, *[e["content"] for e in rest]]) == want == json.loads(final["payload"])["final_response"]
    assert [name for name, state in states.items() if state.exists()] == ["closed"]
    assert list(processor.handleInputRows((1,), [row("chunk", 0, "again")], None)) == []


def test_rows_are_gathered_before_the_state():
    schema = pa.schema([("request_num", pa.int64()), ("kind", pa.string()), ("seq", pa.int64()), ("content", pa.string())])
    rows = [(n, "chunk", k, f"{n} é\n{k}" if k % 3 else None) for k in range(40) for n in (None, 0, 7, 3)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + 50]], schema) for i in range(0, 160, 50)]
    out = [r for b in E._gather(iter([pa.RecordBatch.from_pylist([], schema), *batches])) for r in b.to_pylist()]
    assert [r["request_num"] for r in out] == [0, 3, 7, None]
    for r in out:
        assert [(r["request_num"], *p.values()) for p in r["rows"]] == [x for x in rows if x[0] == r["request_num"]]
    assert list(E._gather(iter([]))) == []


def test_events_of_a_request_leave_the_state_as_one_row():
    many = LITERALS + cases(25, 5, 12)
    for i, (chunks, mapping) in enumerate(many):
        plain, gathered = (kind(True, None, True) for kind in (E._Restoring, E._Gathered))
        plain.init(_Handle())
        gathered.init(_Handle())
        rows = [dict(zip(("kind", "seq", "content"), r[1:], strict=True)) for r in tagged_rows([(chunks, mapping)], {0} if i % 2 else ())]
        want = [tuple(r)[1:] for r in plain.handleInputRows((0,), rows, None)]
        (row,) = gathered.handleInputRows((0,), [{"rows": json.dumps(rows[3:])}, {"rows": json.dumps(rows[:3])}], None)
        assert [(row["event_seq"] + k, *e) for k, e in enumerate(json.loads(row["events"]))] == want
        assert list(gathered.handleInputRows((0,), [{"rows": json.dumps(rows)}], None)) == []
