"""One Spark query per operator. Each takes (spark, folder of Parquet tables)."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import maskflow as mf
from checks import derive as X
from maskflow.functions import detect as D
from maskflow.functions import mask as M
from maskflow.functions import patterns as P
from maskflow.functions import restore as R
from maskflow.operators import audit as A
from maskflow.operators import completion as C
from maskflow.operators import holdback as H
from maskflow.operators import masking as K
from maskflow.operators.prefix import running_totals
from maskflow.plans.requests import result_records
from maskflow.session import materialize, new_path, spread
from maskflow.sources import requests as S
from maskflow.streaming import events as E
from maskflow.streaming import sinks as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- inputs ---------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


def derived(spark: SparkSession, sf: str, sql: str, source: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {source}", "FROM {src}"), src=table(spark, sf, source))


def raw_requests(spark, sf) -> DataFrame:
    return derived(spark, sf, X.REQUESTS, "customer")


def requests(spark, sf) -> DataFrame:
    return S.project_requests(raw_requests(spark, sf))


def recorded(masked: DataFrame) -> DataFrame:
    return masked.filter(X.HAS_RESPONSE).selectExpr(
        "request_num", f"{X.RESPONSE} AS response", f"{X.RESPONSE_ERROR} AS error"
    )


def chunks_of(texts: DataFrame, pattern: str = X.CHUNK) -> DataFrame:
    """Chunk rows (request_id, seq, content) of (request_id, answer)."""
    pieces = F.regexp_extract_all("answer", F.lit(pattern), F.lit(0))
    return texts.select("request_id", F.posexplode(pieces).alias("seq", "content")).withColumn(
        "seq", F.col("seq").cast("long")
    )


def streamed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Chunks and mappings of the streamed answers to all requests."""
    # Written, as chunks and mappings are read by several branches, and patterns are costly.
    masked = mf.mask_requests(requests(spark, sf), "request")
    masked = materialize(masked.select("request_num", "redacted_system", "redacted_user", "mappings"), "masked")
    answers = masked.selectExpr("request_num AS request_id", f"{X.STREAMED} AS answer")
    mappings = masked.select(F.col("request_num").alias("request_id"), F.col("mappings").alias("mapping"))
    return chunks_of(answers), mappings


def document_chunks(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Chunks and mappings of whole masked documents."""
    masked = mf.mask_column(table(spark, sf, "documents"), "doc_id", "text", "request")
    answers = masked.selectExpr("doc_id AS request_id", "redacted_text AS answer")
    mappings = masked.select(
        F.col("doc_id").alias("request_id"), M.mapping(F.col("entries")).alias("mapping")
    )
    return chunks_of(answers, X.CHUNK_LONG), mappings


def with_workers(fn):
    """Make the packages known to Python workers, wherever the session runs."""

    @functools.wraps(fn)
    def run(spark, sf):
        shipped = spark.conf.get("maskflow.shipped", "")
        if not shipped:
            root = Path(__file__).resolve().parent.parent
            path = Path(tempfile.mkdtemp(prefix="maskflow-zip-")) / "maskflow.zip"
            with zipfile.ZipFile(path, "w") as z:
                for package in ("maskflow", "checks"):
                    for file in sorted((root / package).rglob("*.py")):
                        z.write(file, file.relative_to(root))
            spark.sparkContext.addPyFile(str(path))
            spark.conf.set("maskflow.shipped", str(path))
        return fn(spark, sf)

    return run


@contextlib.contextmanager
def state_partitions(spark):
    """Two partitions a core for what starts within; the state of a stream keeps its number of them for good."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(max(8, 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def drained(df: DataFrame, schema: str | None = None) -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    spark = df.sparkSession
    path = new_path(spark, "stream")
    with state_partitions(spark):
        W.write_stream(df, path, new_path(spark, "progress")).awaitTermination()
    return spark.read.schema(schema or df.schema).parquet(path)


def as_stream(df: DataFrame) -> DataFrame:
    """The rows of a table as a file stream, spread over files without order."""
    path = new_path(df.sparkSession, "arrivals")
    df.repartition(max(4, df.sparkSession.sparkContext.defaultParallelism)).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def write_csv(df: DataFrame) -> str:
    path = new_path(df.sparkSession, "csv")
    df.write.options(header=True, escape='"').csv(path)
    return path


# ---- sources, sinks, row shaping ------------------------------------------


@query
def read_requests(spark, sf):
    rows = raw_requests(spark, sf).withColumn("extra", F.lit("x"))
    path = write_csv(rows.orderBy("request_num").drop("request_num"))
    return mf.read_requests(spark, path)


@query
def read_requests_split(spark, sf):
    """Cells with line breaks, read by file block; numbers follow file order."""
    path = write_csv(raw_requests(spark, sf).orderBy("request_num").drop("request_num"))
    return mf.read_requests(spark, path, multi_line="split")


@query
def normalize_text(spark, sf):
    return raw_requests(spark, sf).select(
        "request_num",
        mf.normalize_text(F.col("system_prompt")).alias("system_prompt"),
        mf.normalize_text(F.col("prompt")).alias("prompt"),
    )


@query
def number_requests(spark, sf):
    return mf.number_requests(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query
def number_repeated(spark, sf):
    """Keys that repeat get consecutive numbers."""
    keys = table(spark, sf, "orders").selectExpr("o_custkey")
    return mf.number_requests(keys, "o_custkey")


@query
def unredact_layout(spark, sf):
    """Line breaks and indentation around placeholders stay as they are."""
    masked = mf.mask_requests(requests(spark, sf), "session")
    letter = F.concat(F.lit("Dear\n\n    "), "redacted_user", F.lit("\n\t"), "redacted_system", F.lit("\n  \n"))
    return masked.select("request_num", R.unredact(letter, F.col("mappings")).alias("restored"))


@query
def stream_requests(spark, sf):
    """Columns are found by name: the files have others, and another order."""
    raw = raw_requests(spark, sf).withColumn("extra", F.lit("x"))
    path = write_csv(raw.select("prompt", "extra", "request_num", "system_prompt"))
    masked = E.mask_stream(mf.read_requests_stream(spark, path))
    return drained(masked.select("request_num", "redacted_system", "redacted_user"))


@query
def stream_session(spark, sf):
    """Numbers that run over a stream; one micro-batch here, so they are checkable."""
    path, out = write_csv(raw_requests(spark, sf)), new_path(spark, "masked")
    stream = mf.read_requests_stream(spark, path)
    W.write_masked_session_stream(stream, out, new_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("request_num", "redacted_system", "redacted_user")


@query
def stream_session_batches(spark, sf):
    """Numbers that go on from micro-batch to micro-batch: a third of the requests in each."""
    raw, path, out = raw_requests(spark, sf), new_path(spark, "csv"), new_path(spark, "masked")
    last = raw.agg(F.max("request_num")).first()[0]
    for part in range(3):
        third = raw.filter(F.floor(3 * (F.col("request_num") - 1) / last) == part)
        third.coalesce(1).write.options(header=True, escape='"').csv(f"{path}/part{part}")
    stream = mf.read_requests_stream(spark, f"{path}/*", files_per_batch=1)
    W.write_masked_session_stream(stream, out, new_path(spark, "progress")).awaitTermination()
    return W.read_committed(spark, out).select("batch", "request_num", "redacted_system", "redacted_user")


@query
def results_table(spark, sf):
    masked = mf.mask_requests(requests(spark, sf), "session")
    results = mf.process_requests(requests(spark, sf), responses=recorded(masked))
    path = new_path(spark, "results")
    mf.write_results(results, path)
    return spark.read.parquet(path)


@query
def vault(spark, sf):
    rows = mf.vault(mf.mask_requests(requests(spark, sf), "session"))
    path = new_path(spark, "vault")
    mf.write_vault(rows, path)
    return spark.read.parquet(path).withColumn("ord", F.col("ord").cast("long"))


# ---- detection ------------------------------------------------------------


def _hits(df: DataFrame, key: str, text: str, entities=None) -> DataFrame:
    rows = mf.hit_rows(df, key, text, entities)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("pos", "start", "end")})


@query
def detect_spans(spark, sf):
    return _hits(table(spark, sf, "documents"), "doc_id", "text")


@query
def detect_spans_requests(spark, sf):
    return _hits(requests(spark, sf), "request_num", "prompt")


@query
def detect_ssn(spark, sf):
    return _hits(requests(spark, sf), "request_num", "system_prompt", ["US_SSN"])


@query
def detect_email(spark, sf):
    return _hits(table(spark, sf, "pages"), "page_id", "html", ["EMAIL_ADDRESS"])


@query
def detect_phone(spark, sf):
    return _hits(table(spark, sf, "documents"), "doc_id", "text", ["PHONE_NUMBER"])


@query
def detect_subset(spark, sf):
    return _hits(requests(spark, sf), "request_num", "prompt", ["US_SSN", "PHONE_NUMBER"])


@query
def detect_lang_en(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    masked = mf.mask_column(docs, "doc_id", "text", only=F.col("lang") == "en")
    return masked.select("doc_id", "lang", "redacted_text")


@query
def detect_overlap(spark, sf):
    return _hits(derived(spark, sf, X.OVERLAP, "customer"), "c_custkey", "text")


@query
def filter_has_pii(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(mf.has_pii(F.col("text"))).select("doc_id", "source")


@query
def hits_lateral_view(spark, sf):
    mf.register_sql_functions(spark)
    return spark.sql(
        """SELECT request_num, CAST(pos AS BIGINT) AS pos, h.entity_type, h.value
           FROM (SELECT request_num, detect(prompt) AS hits FROM {src})
           LATERAL VIEW posexplode(hits) AS pos, h""",
        src=requests(spark, sf),
    )


@query
def sql_functions(spark, sf):
    mf.register_sql_functions(spark)
    return spark.sql(
        """SELECT request_num, has_pii(prompt) AS has_pii, redact(prompt) AS redacted,
                  unredact('for US_SSN_0001', map('US_SSN_0001', system_prompt)) AS restored
           FROM {src}""",
        src=requests(spark, sf),
    )


# ---- masking --------------------------------------------------------------


@query
def placeholder_format(spark, sf):
    kind = F.expr(X.ENTITY_BY_KEY)
    return table(spark, sf, "orders").select(
        "o_orderkey", M.placeholder(kind, F.col("o_orderkey")).alias("placeholder")
    )


@query
def rank_in_text(spark, sf):
    found = K.with_hits(requests(spark, sf).select("request_num", "prompt"), ["prompt"])
    ranks = M.ranks(F.col("_t_prompt"), P.ENTITIES, [F.lit(0)] * len(P.ENTITIES))
    both = F.arrays_zip(F.col("_t_prompt").alias("t"), ranks.alias("n"))
    rows = found.select("request_num", F.posexplode(both).alias("pos", "h"))
    return rows.select(
        "request_num",
        F.col("pos").cast("long").alias("pos"),
        F.col("h.t").alias("entity_type"),
        F.col("h.n").alias("rank"),
    )


def _numbering(spark, sf, scope, parts=None):
    masked = mf.mask_requests(requests(spark, sf), scope, parts=parts)
    rows = mf.vault(masked)
    return rows.select("request_num", F.col("ord").cast("long").alias("ord"), "placeholder")


@query
def session_numbering(spark, sf):
    return _numbering(spark, sf, "session")


@query
def session_numbering_bucketed(spark, sf):
    return _numbering(spark, sf, "session", parts=16)


@query
def request_numbering(spark, sf):
    return _numbering(spark, sf, "request")


@query
def redact_text(spark, sf):
    masked = mf.mask_column(requests(spark, sf), "request_num", "prompt", "request")
    return masked.select("request_num", "redacted_prompt")


@query
def mapping_rows(spark, sf):
    rows = mf.vault(mf.mask_column(table(spark, sf, "documents"), "doc_id", "text"), "doc_id")
    return rows.drop("field").withColumn("ord", F.col("ord").cast("long"))


@query
def redact_passthrough(spark, sf):
    masked = mf.mask_requests(raw_requests(spark, sf), "request")
    return masked.select(
        "request_num",
        "redacted_system",
        "redacted_user",
        F.size("mappings").cast("long").alias("n_mappings"),
    )


@query
def request_mappings(spark, sf):
    masked = mf.mask_requests(requests(spark, sf), "session")

    def of(field: str):
        return M.mapping(F.filter("entries", lambda e: e["field"] == field))

    merged = masked.select("request_num", M.merge_mappings(of("system"), of("user")).alias("m"))
    rows = merged.select("request_num", F.posexplode("m").alias("ord", "placeholder", "original"))
    return rows.withColumn("ord", F.col("ord").cast("long"))


@query
def redact_requests(spark, sf):
    masked = mf.mask_requests(requests(spark, sf), "session")
    return masked.select("request_num", "redacted_system", "redacted_user")


@query
def entity_totals(spark, sf):
    return mf.entity_totals(requests(spark, sf), ["system_prompt", "prompt"])


@query
def redact_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mf.mask_column(docs, "doc_id", "text").select("doc_id", "redacted_text")


@query
def redact_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "html")
    return mf.mask_column(pages, "page_id", "html").select("page_id", "redacted_html")


# ---- completion -----------------------------------------------------------


@query
def chat_messages(spark, sf):
    masked = mf.mask_requests(requests(spark, sf), "request")
    messages = mf.build_messages(F.col("redacted_system"), F.col("redacted_user"))
    rows = masked.select("request_num", F.posexplode(messages).alias("position", "m"))
    return rows.select(
        "request_num", F.col("position").cast("long").alias("position"), "m.role", "m.content"
    )


@query
def conversation_messages(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content"), F.lit(1).cast("long").alias("one")
    )
    placed = running_totals(turns, ["turn"], {"position": "one"}, group=["conv_id"])
    return placed.select("conv_id", "position", "role", "content")


@query
def attach_responses(spark, sf):
    masked = mf.mask_requests(requests(spark, sf), "request")
    joined = mf.attach_responses(masked, recorded(masked))
    return joined.select("request_num", "response", "error")


def _echo(model):
    def complete(system, user):
        return f"{model}: {user} | {system}"

    return complete


@query
@with_workers
def complete_echo(spark, sf):
    return mf.complete_with(mf.mask_requests(requests(spark, sf), "request"), _echo, "echo")


@query
def chunks_nonempty(spark, sf):
    chunks, _ = streamed(spark, sf)
    holes = F.when(F.col("seq") % 5 == 3, F.lit("")).when(F.col("seq") % 5 == 1, F.lit(None))
    content = F.when(F.col("seq") % 5 % 2 == 1, holes).otherwise(F.col("content"))
    return C.nonempty_chunks(chunks.withColumn("content", content))


@query
def error_wrap(spark, sf):
    masked = mf.mask_requests(requests(spark, sf), "request")
    return recorded(masked).select(
        "request_num",
        C.wrap_error(F.col("error")).alias("error"),
        C.wrap_error(F.col("error"), C.STREAM_FAILED).alias("stream_error"),
    )


def _picky(model):
    def complete(system, user):
        if "helpful" in system:
            raise RuntimeError("API rate limit exceeded")
        return f"{system}: {user}"

    return complete


@query
@with_workers
def error_isolation(spark, sf):
    results = mf.process_requests(requests(spark, sf), _picky)
    return results.select(
        "request_num",
        "original_user",
        "redacted_user",
        F.size("mappings").cast("long").alias("n_mappings"),
        "final_response",
        "error",
    )


def _results(spark, sf, scope="session") -> DataFrame:
    masked = mf.mask_requests(requests(spark, sf), scope)
    answered = mf.attach_responses(masked, recorded(masked))
    return result_records(answered)


@query
def null_response(spark, sf):
    return _results(spark, sf).select(
        "request_num",
        F.col("final_response").isNull().alias("is_null"),
        F.col("error").isNull().alias("is_success"),
    )


# ---- restoring ------------------------------------------------------------


@query
def unredact(spark, sf):
    masked = mf.mask_requests(requests(spark, sf), "session")
    text = F.concat_ws(" & ", "redacted_user", "redacted_system", "redacted_user")
    return masked.select("request_num", mf.unredact(text, F.col("mappings")).alias("restored"))


@query
def unredact_passthrough(spark, sf):
    none = F.create_map().cast("map<string,string>")
    some = F.create_map(F.lit("US_SSN_0001"), F.lit("x"))
    return raw_requests(spark, sf).select(
        "request_num",
        mf.unredact(F.col("system_prompt"), some).alias("kept_null"),
        mf.unredact(F.col("prompt"), none).alias("kept_text"),
        mf.unredact(F.left("prompt", F.lit(0)), some).alias("kept_empty"),
    )


@query
def unredact_unknown(spark, sf):
    masked = mf.mask_requests(requests(spark, sf), "request")
    text = F.concat(F.col("redacted_user"), F.lit(" or EMAIL_ADDRESS_0777, US_SSN_0002"))
    return masked.select("request_num", mf.unredact(text, F.col("mappings")).alias("restored"))


@query
def unredact_tokens(spark, sf):
    masked = mf.mask_requests(requests(spark, sf), "session")
    text = F.concat_ws(" & ", "redacted_user", "redacted_system", F.lit("US_SSN_0"))
    return masked.select(
        "request_num", mf.unredact_tokens(text, F.col("mappings")).alias("restored")
    )


@query
def unredact_vault(spark, sf):
    stored = mf.vault(mf.mask_requests(requests(spark, sf), "request"))
    answers = derived(spark, sf, X.ORDER_ANSWERS, "orders")
    out = mf.unredact_with_vault(answers, stored, "o_orderkey", "answer", ["request_num"])
    return out.select("o_orderkey", "restored")


# ---- chunked answers ------------------------------------------------------


@query
def holdback_length(spark, sf):
    masked = mf.mask_requests(requests(spark, sf), "session")
    hold = mf.holdback_length(F.col("mappings")).cast("long")
    return masked.select("request_num", hold.alias("hold"))


@query
def holdback_batch(spark, sf):
    released = mf.release_chunks(*streamed(spark, sf))
    return released.filter("seq IS NOT NULL")


@query
def holdback_flush(spark, sf):
    released = mf.release_chunks(*streamed(spark, sf))
    return released.filter("seq IS NULL").select("request_id", "content")


def _broken(spark, sf) -> DataFrame:
    return requests(spark, sf).filter(X.BROKEN).select(F.col("request_num").alias("request_id"), F.lit(X.BROKEN_CAUSE).alias("error"))


def _broken_off(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks and mappings of ``streamed``, some answers broken off, and which."""
    chunks, mappings = streamed(spark, sf)
    fails = F.expr(X.BROKEN.replace("request_num", "request_id"))
    return chunks.filter(~fails | (F.col("seq") < X.BROKEN_AT)), mappings, _broken(spark, sf)


@query
def holdback_broken(spark, sf):
    """All that is released, the rests included; nothing held back of answers that broke off."""
    return mf.release_chunks(*_broken_off(spark, sf))


@query
def final_broken(spark, sf):
    return mf.full_answers(*_broken_off(spark, sf))


@query
def holdback_rest_nomap(spark, sf):
    """Without placeholders nothing is held back, so each rest is empty."""
    chunks, mappings = document_chunks(spark, sf)
    none = F.create_map().cast("map<string,string>")
    released = mf.release_chunks(chunks, mappings.withColumn("mapping", none))
    return released.filter("seq IS NULL").select("request_id", "content")


@query
def holdback_nomap(spark, sf):
    chunks, mappings = document_chunks(spark, sf)
    none = F.create_map().cast("map<string,string>")
    released = mf.release_chunks(chunks, mappings.withColumn("mapping", none))
    return released.filter("seq IS NOT NULL")


@query
def stream_final(spark, sf):
    return mf.full_answers(*document_chunks(spark, sf))


def tagged(spark, sf, broken: bool) -> DataFrame:
    """Tagged rows of all streamed answers."""
    masked = mf.mask_requests(requests(spark, sf), "request")
    chunks = chunks_of(masked.selectExpr("request_num AS request_id", f"{X.STREAMED} AS answer"))
    chunks = chunks.withColumnRenamed("request_id", "request_num")
    fails = F.expr(X.BROKEN) if broken else F.lit(False)
    said = chunks.filter(~fails | (F.col("seq") < X.BROKEN_AT))
    said = said.select("request_num", F.lit("chunk").alias("kind"), "seq", "content")
    stops = F.when(fails, F.least("n", F.lit(X.BROKEN_AT))).otherwise(F.col("n"))
    ends = chunks.groupBy("request_num").agg(F.count(F.lit(1)).alias("n"))
    ends = ends.select(
        "request_num",
        F.when(fails, "error").otherwise("end").alias("kind"),
        stops.alias("seq"),
        F.when(fails, F.lit(X.BROKEN_CAUSE)).alias("content"),
    )
    return E.open_rows(masked).unionByName(said).unionByName(ends)


def _events(spark, sf, broken: bool = False) -> DataFrame:
    return drained(mf.restore_stream(as_stream(tagged(spark, sf, broken))), E.EVENTS)


@query
@with_workers
def holdback_stream(spark, sf):
    events = _events(spark, sf).filter("type = 'chunk'")
    return events.select("request_num", F.col("chunk_seq").alias("seq"), "content")


@query
@with_workers
def stream_error(spark, sf):
    events = _events(spark, sf, broken=True).filter(X.BROKEN)
    return events.select(
        "request_num",
        F.col("event_seq").cast("long").alias("event_seq"),
        "type",
        "content",
        "original_user",
        "error",
    )


@query
@with_workers
def stream_outcomes(spark, sf):
    """All events of all streams, whole and broken off."""
    events = _events(spark, sf, broken=True)
    return events.select(
        "request_num",
        F.col("event_seq").cast("long").alias("event_seq"),
        "type",
        "chunk_seq",
        "content",
        "original_system",
        "original_user",
        "redacted_system",
        "redacted_user",
        F.to_json("mappings").alias("mappings"),
        "llm_response_redacted",
        "final_response",
        "error",
    )


@query
@with_workers
def stream_summary(spark, sf):
    return mf.stream_summary(_events(spark, sf, broken=True))


def _two_sinks(spark, sf) -> tuple[str, str]:
    """Events and vault of all streams, written by micro-batches; run again on nothing new."""
    out, kept, progress = (new_path(spark, name) for name in ("events", "vault", "progress"))
    stream = mf.restore_stream(as_stream(tagged(spark, sf, True)))
    for _ in range(2):
        with state_partitions(spark):
            W.write_event_stream(stream, out, progress, kept).awaitTermination()
    return out, kept


@query
@with_workers
def sink_events(spark, sf):
    out, _ = _two_sinks(spark, sf)
    return W.read_committed(spark, out).select(
        "request_num", F.col("event_seq").cast("long").alias("event_seq"), "type", "content", "final_response", "error"
    )


@query
@with_workers
def sink_vault(spark, sf):
    rows = W.read_committed(spark, *_two_sinks(spark, sf))
    return rows.select("request_num", F.col("ord").cast("long").alias("ord"), "placeholder", "original")


def _words(model):
    def complete(system, user):
        yield ""
        for word in f"Dear {system}, I wrote to {user} today".split(" "):
            yield word + " "

    return complete


@query
@with_workers
def stream_events(spark, sf):
    path = write_csv(raw_requests(spark, sf))
    stream = mf.process_requests_stream(mf.read_requests_stream(spark, path), _words)
    events = drained(stream, E.EVENTS)
    return events.select(
        "request_num",
        F.col("event_seq").cast("long").alias("event_seq"),
        "type",
        "content",
        "redacted_user",
        F.size("mappings").cast("long").alias("n_mappings"),
        "llm_response_redacted",
        "final_response",
    )


# ---- flows ----------------------------------------------------------------


@query
def process_requests(spark, sf):
    results = _results(spark, sf)
    return results.select(
        "request_num",
        "original_system",
        "original_user",
        "redacted_system",
        "redacted_user",
        F.size("mappings").cast("long").alias("n_mappings"),
        "llm_response_redacted",
        "final_response",
        "error",
    )


@query
@with_workers
def process_csv(spark, sf):
    rows = raw_requests(spark, sf).orderBy("request_num").drop("request_num")
    results = mf.process_csv(spark, write_csv(rows), _picky)
    return results.select("request_num", "redacted_user", "final_response", "error")


@query
def summary(spark, sf):
    return mf.summarize(_results(spark, sf))


@query
def preview(spark, sf):
    return mf.preview(_results(spark, sf), 60)


# ---- audits ---------------------------------------------------------------


@query
def audit_leaks(spark, sf):
    """Leaks of the masked requests (none), and of the same requests left unmasked."""
    masked = mf.mask_requests(requests(spark, sf), "session")
    open_ = masked.withColumn("redacted_user", F.col("original_user"))
    rows = A.leak_rows(masked).select("request_num", F.lit("masked").alias("variant"))
    return rows.unionByName(A.leak_rows(open_).select("request_num", F.lit("open").alias("variant")))


@query
def audit_roundtrip(spark, sf):
    """Round trips of the masked requests (all good), and with a changed mapping."""
    masked = mf.mask_requests(requests(spark, sf), "session")
    bad = masked.withColumn(
        "mappings", F.map_filter("mappings", lambda k, _: ~k.startswith("US_SSN"))
    )
    rows = A.roundtrip_failures(masked).select("request_num", F.lit("kept").alias("variant"))
    return rows.unionByName(
        A.roundtrip_failures(bad).select("request_num", F.lit("changed").alias("variant"))
    )


@query
def audit_partial(spark, sf):
    """Placeholders cut by raw chunk limits, and by released pieces (none)."""
    rows = H.splits(*streamed(spark, sf))
    variant = F.when(F.col("held"), "held").otherwise("raw")
    return rows.select("request_id", "seq", "placeholder", variant.alias("variant"))


@query
def audit_collision(spark, sf):
    texts = derived(spark, sf, X.COLLIDING, "customer")
    return texts.filter(A.collides(F.col("text"))).select("c_custkey", "text")


@query
def pii_profile(spark, sf):
    return A.pii_profile(table(spark, sf, "documents"), "text", ["lang", "source"])
