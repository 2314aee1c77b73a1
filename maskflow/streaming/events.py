"""Streaming: masked requests in, restored chunks out, as one event stream.

All rows of a request meet in one keyed state. Rows are tagged: ``open`` (seq
-1, carries the prompts and the mapping), ``chunk``, then ``end`` or
``error``. They may come in any order and more than once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from maskflow.functions.restore import Restorer
from maskflow.operators.completion import STREAM_FAILED
from maskflow.operators.masking import mask_requests

TAGGED = "request_num long, kind string, seq long, content string"
EVENTS = (
    "request_num long, event_seq int, type string, chunk_seq long, content string, "
    "original_system string, original_user string, redacted_system string, "
    "redacted_user string, mappings map<string,string>, "
    "llm_response_redacted string, final_response string, error string"
)
_RAW_EVENTS = "request_num long, event_seq int, events string"
#: Rows of requests that come in one micro-batch, as they go to the state.
_GATHERED = "request_num long, rows array<struct<kind:string,seq:long,content:string>>"
#: Rows and bytes that are gathered at a time, and requests of a batch given on.
_GATHER_ROWS, _GATHER_BYTES, _GATHER_OUT = 1_000_000, 128 << 20, 10_000
_PAYLOAD = (
    "original_system string, original_user string, redacted_system string, "
    "redacted_user string, mappings map<string,string>, "
    "llm_response_redacted string, final_response string, error string"
)
TIMED_OUT = "stream timed out"

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CompleteStream = Callable[[str, str], Iterable[str]]


def mask_stream(requests: DataFrame, entities=None) -> DataFrame:
    """Masked requests of a stream: numbers restart in each request, no state."""
    return mask_requests(requests, "request", entities)


def _payload() -> Column:
    return F.to_json(
        F.struct(
            "original_system", "original_user", "redacted_system", "redacted_user", "mappings"
        )
    )


def open_rows(masked: DataFrame) -> DataFrame:
    """The ``open`` row of each masked request."""
    return masked.select(
        "request_num",
        F.lit("open").alias("kind"),
        F.lit(-1).cast("long").alias("seq"),
        _payload().alias("content"),
    )


def call_model(
    masked: DataFrame,
    connect: Callable[[str], CompleteStream],
    model: str = "default",
    prefix: str = STREAM_FAILED,
    rows_per_batch: int = 1000,
) -> DataFrame:
    """Tagged rows of masked requests, the chunks coming from a user function.

    ``connect(model)`` runs once per task; its result gets the two masked texts
    and gives chunks. Chunks without text are dropped.
    """
    sent = masked.select(
        "request_num", "redacted_system", "redacted_user", _payload().alias("_payload")
    )

    def tagged(complete: CompleteStream, batch: pd.DataFrame) -> Iterator[tuple]:
        for num, system, user, payload in batch.itertuples(index=False):
            yield num, "open", -1, payload
            seq = 0
            try:
                for chunk in complete(system, user):
                    if chunk:
                        yield num, "chunk", seq, chunk
                        seq += 1
            except Exception as cause:
                yield num, "error", seq, f"{prefix}{cause}"
            else:
                yield num, "end", seq, None

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = connect(model)
        columns = ["request_num", "kind", "seq", "content"]
        for batch in batches:
            rows: list[tuple] = []
            for row in tagged(complete, batch):
                rows.append(row)
                if len(rows) >= rows_per_batch:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return sent.mapInPandas(call, TAGGED)


class _Entries:
    """The mapping of a request as its state holds it: each key is looked up once, none is listed."""

    def __init__(self, state):
        self.state, self.seen = state, {}

    def get(self, key: str) -> str | None:
        if key not in self.seen:
            found = self.state.getValue((key,))
            self.seen[key] = None if found is None else found[0]
        return self.seen[key]

    def __contains__(self, key: str) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key: str) -> str:
        return self.get(key)


class _Restoring(StatefulProcessor):
    """One request at a time: tagged rows in, events out.

    State: ``place`` (next chunk, events so far, text held back) is all that a
    micro-batch writes anew; ``entries`` is a map, of which only the keys in
    the text are read; ``answer`` is a list that is only added to; ``early``
    has rows that came before their turn; ``originals`` are written once and
    read for an error alone, and so not at all if ``keep_originals`` is off.
    """

    def __init__(self, keep_final: bool, timeout_ms: int | None, keep_originals: bool):
        self.keep_final, self.timeout_ms, self.keep_originals = keep_final, timeout_ms, keep_originals

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, events int, early int, buffer string")
        self.facts = handle.getValueState("facts", "names string, hold int")
        self.originals = handle.getValueState("originals", "original_system string, original_user string")
        self.entries = handle.getMapState("entries", "placeholder string", "original string")
        self.early = handle.getMapState("early", "seq long", "kind string, content string")
        self.answer = handle.getListState("answer", "content string")
        self.closed = handle.getValueState("closed", "closed boolean", self.timeout_ms)

    def _keep(self, opened: dict, facts: tuple[list[str], int]) -> None:
        self.facts.update((json.dumps(facts[0]), facts[1]))
        for key, value in (opened.get("mappings") or {}).items():
            self.entries.updateValue((key,), (value,))
        if self.keep_originals:
            self.originals.update((opened.get("original_system"), opened.get("original_user")))

    def _error(self, cause: str | None, opened: dict | None) -> tuple:
        named = ("original_system", "original_user")
        if opened is None:
            values = (self.originals.get() if self.keep_originals else None) or (None, None)
        else:
            values = [opened.get(k) if self.keep_originals else None for k in named]
        return "error", None, None, json.dumps({**dict(zip(named, values, strict=True)), "error": cause})

    def _close(self, early: int) -> None:
        states = [self.place, self.facts, self.originals, self.entries, self.answer]
        for state in [*states, self.early] if early else states:
            state.clear()

    @staticmethod
    def _row(num: int, at: int, kind: str, seq: int | None, content: str | None, payload: str | None) -> Row:
        return Row(request_num=num, event_seq=at, type=kind, chunk_seq=seq, content=content, payload=payload)

    def _wait(self, now: int) -> None:
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(now + self.timeout_ms)

    def _steps(self, rows: list[tuple], place: list, known: bool) -> Iterator[tuple | None]:
        """Events of the rows; ``place`` is changed as they go. Ends with None if the request does.

        ``known``: earlier micro-batches left something. Nothing is written
        before the rows are through, so a request that comes whole leaves its mark alone.
        """
        facts, opened, rule, told = self.facts.get() if known else None, None, None, []
        if facts is not None:
            facts = (json.loads(facts[0]), facts[1])
        waiting = {seq: (kind, content) for kind, seq, content in reversed(rows) if kind != "open" and seq >= place[0]}
        if facts is None:
            first = next((content for kind, _, content in rows if kind == "open"), None)
            if first is not None:
                opened = json.loads(first)
                facts = Restorer.facts(opened.get("mappings") or {})
                yield "metadata", None, None, first
        while facts is not None:
            found = waiting.pop(place[0], None)
            if found is None and place[2]:
                found = self.early.getValue((place[0],))
                if found is not None:
                    self.early.removeKey((place[0],))
                    place[2] -= 1
            if found is None:
                break
            (kind, content), seq = found, place[0]
            if rule is None:
                rule = Restorer(_Entries(self.entries) if opened is None else opened.get("mappings") or {}, *facts)
            place[0] += 1
            if kind == "chunk" and content:
                place[3] += content
                if self.keep_final:
                    told.append(content)
                cut = rule.safe_length(place[3])
                out, place[3] = rule.restore(place[3][:cut]), place[3][cut:]
                if out:
                    yield "chunk", seq, out, None
            elif kind == "end":
                if place[3]:
                    yield "chunk", None, rule.restore(place[3]), None
                whole = None
                if self.keep_final:
                    whole = "".join([*((r[0] for r in self.answer.get()) if known else ()), *told])
                final = {"llm_response_redacted": whole, "final_response": rule.restore(whole) if self.keep_final else None}
                yield "final", None, None, json.dumps(final)
                yield None
                return
            elif kind == "error":
                yield self._error(content, opened)
                yield None
                return
        if opened is not None:
            self._keep(opened, facts)
        if told:
            self.answer.appendValue(("".join(told),))
        for seq, (kind, content) in waiting.items():
            if not place[2] or not self.early.containsKey((seq,)):
                self.early.updateValue((seq,), (kind, content))
                place[2] += 1

    def _events(self, given: list[tuple], timerValues) -> Iterator[tuple]:  # noqa: N803 (Spark's name)
        """(event_seq, type, chunk_seq, content, payload) of the rows of a request."""
        saved = self.place.get()
        if saved is None and self.closed.exists():
            # Repeats after the end of a request give nothing.
            return
        now = timerValues.getCurrentProcessingTimeInMs() if self.timeout_ms is not None else 0
        place = list(saved or (0, 0, 0, ""))
        for event in self._steps(given, place, saved is not None):
            if event is None:
                if saved is not None:
                    self._close(place[2])
                self.closed.update((True,))
                self._wait(now)
                return
            yield place[1], *event
            place[1] += 1
        self.place.update(tuple(place))
        self._wait(now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 (Spark's names)
        for event in self._events([(r["kind"], r["seq"], r["content"]) for r in rows], timerValues):
            yield self._row(key[0], *event)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        place = self.place.get()
        if place is None:
            self.closed.clear()
            return
        opened = self.facts.exists()
        error = self._error(TIMED_OUT, None)[3]
        self._close(place[2])
        if opened:
            yield self._row(key[0], place[1], "error", None, None, error)

    def close(self) -> None:
        pass


class _Gathered(_Restoring):
    """The same for rows that come gathered as JSON; the events of a request go out as one row.

    Each row between the engine and Python, in or out, costs more than what is done with it here.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        given = [(r.get("kind"), r.get("seq"), r.get("content")) for row in rows for r in json.loads(row["rows"])]
        events = list(self._events(given, timerValues))
        if events:
            yield Row(request_num=key[0], event_seq=events[0][0], events=json.dumps([e[1:] for e in events], ensure_ascii=False))

    @staticmethod
    def _row(num: int, at: int, kind: str, seq: int | None, content: str | None, payload: str | None) -> Row:
        return Row(request_num=num, event_seq=at, events=json.dumps([[kind, seq, content, payload]], ensure_ascii=False))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the same request as one, as far as they come within ``_GATHER_ROWS`` rows; in the order they came."""

    def gathered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows["request_num"])).combine_chunks()
        key, kind, seq, content = (rows[c].combine_chunks() for c in ("request_num", "kind", "seq", "content"))
        values, null = pc.fill_null(key, 0).to_numpy(), pc.is_null(key).to_numpy(zero_copy_only=False)
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (null[1:] != null[:-1])
        starts = np.flatnonzero(new)
        parts = pa.StructArray.from_arrays([kind, seq, content], ["kind", "seq", "content"])
        lists = pa.ListArray.from_arrays(pa.array([*starts.tolist(), len(values)], pa.int32()), parts)
        out = pa.RecordBatch.from_arrays([key.take(pa.array(starts)), lists], ["request_num", "rows"])
        for at in range(0, len(starts), _GATHER_OUT):
            yield out.slice(at, _GATHER_OUT)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= _GATHER_ROWS or sum(b.nbytes for b in held) >= _GATHER_BYTES:
            yield from gathered(held)
            held = []
    if held:
        yield from gathered(held)


def restore_stream(
    tagged: DataFrame, keep_final: bool = True, timeout_ms: int | None = None, keep_originals: bool = True
) -> DataFrame:
    """Events of a stream of tagged rows, in order per request by ``event_seq``.

    ``metadata``, then ``chunk`` events, then ``final`` or ``error``. Nothing
    of a placeholder goes out before all of it is there. On an error the text
    held back is dropped. ``keep_final=False`` keeps the whole answer out of
    the state; the final event then carries no text. ``keep_originals=False``
    keeps the prompts out of it; error events then carry none.

    The state is typed and kept by RocksDB, which the session is told to use: a
    micro-batch writes the place in the answer and what it adds to it, not the
    answer again.

    Of a request that has ended, a small mark stays, so that repeats of its
    rows give no further event; it goes with ``timeout_ms``, else it stays.

    With ``timeout_ms`` an open request that gets no row for so long ends in an
    error event. Use it with triggers that go on: a run that stops when all
    input is read would wait for timeouts for ever.
    """
    spark = tagged.sparkSession
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKSDB)
    processor = _Gathered(keep_final, timeout_ms, keep_originals)
    mode = "none" if timeout_ms is None else "processingTime"
    # The rows of a micro-batch are dealt by request and gathered before they pass the state, which takes rows one by one.
    rows = tagged.selectExpr("CAST(request_num AS LONG)", "kind", "CAST(seq AS LONG) AS seq", "content")
    rows = rows.repartition("request_num").mapInArrow(_gather, _GATHERED)
    rows = rows.select("request_num", F.to_json("rows").alias("rows"))
    raw = rows.groupBy("request_num").transformWithState(processor, _RAW_EVENTS, "append", mode)
    each = F.from_json("events", "array<array<string>>", {"mode": "FAILFAST", "maxStringLen": str((1 << 31) - 1)})
    raw = raw.select("request_num", "event_seq", F.posexplode(each).alias("at", "e"))
    raw = raw.select(
        "request_num",
        (F.col("event_seq") + F.col("at")).alias("event_seq"),
        F.col("e")[0].alias("type"),
        F.col("e")[1].cast("long").alias("chunk_seq"),
        F.col("e")[2].alias("content"),
        F.col("e")[3].alias("payload"),
    )
    fields = [f.strip().split(" ")[0] for f in _PAYLOAD.split(", ")]
    return raw.withColumn("p", F.from_json("payload", _PAYLOAD)).select(
        "request_num", "event_seq", "type", "chunk_seq", "content", *[f"p.{f}" for f in fields]
    )


def process_requests_stream(
    requests: DataFrame,
    connect: Callable[[str], CompleteStream],
    model: str = "default",
    keep_final: bool = True,
    timeout_ms: int | None = None,
) -> DataFrame:
    """Requests in, events out: mask, call the model, restore chunk by chunk."""
    tagged = call_model(mask_stream(requests), connect, model)
    return restore_stream(tagged, keep_final, timeout_ms)


def stream_summary(events: DataFrame) -> DataFrame:
    """One row: total, successful (final events), failed (error events)."""
    return events.agg(
        F.count_if(F.col("type") == "metadata").alias("total"),
        F.count_if(F.col("type") == "final").alias("successful"),
        F.count_if(F.col("type") == "error").alias("failed"),
    )
