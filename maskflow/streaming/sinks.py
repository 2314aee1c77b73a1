"""Stream sinks.

Sinks of two tables write each micro-batch into new folders and then a
manifest that names them, by one rename. A batch is there when its manifest is:
``read_committed`` shows both tables of it or neither, and a batch that is
replayed after its manifest was written is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskflow.functions import patterns as P
from maskflow.operators.masking import entity_totals, mask_requests, vault
from maskflow.sources.sinks import SENSITIVE


def write_stream(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Append a stream to Parquet files, exactly once through its checkpoint."""
    writer = df.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _manifests(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_batches")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _write_batch(path: str, batch_id: int, tables: Mapping[str, Callable[[], DataFrame]]) -> None:
    """Write the tables (folder -> rows) of a micro-batch, then its manifest below ``path``."""
    spark = SparkSession.active()
    fs, folder = _manifests(spark, path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    target = jvm_path(folder, str(batch_id))
    if fs.exists(target):
        return
    attempt = uuid.uuid4().hex
    places = {root: f"{root}/batch={batch_id}/attempt={attempt}" for root in tables}
    for root, rows in tables.items():
        rows().write.parquet(places[root])
    fs.mkdirs(folder)
    draft = jvm_path(folder, f".{attempt}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(places).encode()))
    out.close()
    if not fs.rename(draft, target) and not fs.exists(target):
        raise OSError(f"no manifest for batch {batch_id} below {path}")


def read_committed(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """All batches of a sink of two tables that are whole: the table at ``path``, or the one at ``table``."""
    fs, folder = _manifests(spark, path)
    names = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    places = []
    for name in names:
        if not name.getName().startswith("."):
            stream = fs.open(name)
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            places.append(json.loads(text).get(table or path))
    places = sorted(p for p in places if p)
    if not places:
        raise FileNotFoundError(f"no batch below {table or path} is whole")
    return spark.read.option("basePath", table or path).parquet(*places).drop("attempt")


def write_event_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    vault_path: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Write events to ``path`` and, if asked, their mappings apart from them.

    Both tables get the same micro-batch, or neither does (``read_committed``).
    Restored text is what events are for, so chunk and final texts stay; prompts
    and mappings go to ``vault_path`` or nowhere.
    """
    apart = ("original_system", "original_user", "mappings")

    def write(batch: DataFrame, batch_id: int) -> None:
        entries = F.posexplode("mappings").alias("ord", "placeholder", "original")
        tables = {path: lambda: batch.drop(*apart)}
        if vault_path:
            tables[vault_path] = lambda: batch.filter("type = 'metadata'").select("request_num", entries)
        batch.persist()
        try:
            _write_batch(path, batch_id, tables)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def write_masked_session_stream(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    vault_path: str | None = None,
    entities: Sequence[str] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Mask a stream of requests with numbers that run over the whole stream.

    Each micro-batch is masked in session scope from the counters the batch
    before it left. Counters are written per batch id and overwritten on a
    replay, so a repeated batch gets the same numbers. Masked rows go to
    ``path``; originals only to ``vault_path``, if given (``read_committed``
    shows both tables of a batch or neither).
    """
    names = [e for e in P.ENTITIES if entities is None or e in entities]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        start = dict.fromkeys(names, 0)
        if batch_id:
            before = spark.read.parquet(f"{checkpoint}/counters/{batch_id - 1}")
            start.update({r["entity_type"]: r["used"] for r in before.collect()})
        masked = mask_requests(batch, "session", entities, start).persist()
        tables = {path: lambda: masked.drop(*SENSITIVE)}
        if vault_path:
            tables[vault_path] = lambda: vault(masked)
        try:
            _write_batch(path, batch_id, tables)
        finally:
            masked.unpersist()
        totals = entity_totals(batch, ["system_prompt", "prompt"], entities)
        used = F.create_map(*[F.lit(x) for pair in start.items() for x in pair])
        totals.select(
            "entity_type", (F.col("hits") + used[F.col("entity_type")]).alias("used")
        ).coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/counters/{batch_id}")

    writer = requests.writeStream.foreachBatch(write)
    writer = writer.option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
