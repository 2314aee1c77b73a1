"""Registered queries of this package: one per operator, and the pipeline's rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.llm import conversation_trie, html, lattice, length_packing, licenses, lines, masked_lm, mixing, packing, periodic, quality, secrets, simhash
from maskflow.llm.common import remove_table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_mix_sources(spark, sf):
    """The mix of all documents: words taken of each, and when the first copy is due."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    plan = mixing.plan_mix(docs, "doc_id", "source", word_count(F.col("text")))
    first = F.get("positions", 0).alias("position")
    return plan.select("doc_id", "size", "source_size", "target", "taken", first).orderBy("position", "doc_id")


@query
def op2_secret_scan(spark, sf):
    """Secrets of all documents, scanned blob by blob from an empty ledger."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found, _ = secrets.scan_history(docs, ["doc_id"], "text")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


@query
def op3_embedding_neardup(spark, sf):
    """Near-duplicate classes of all embeddings, cosine 0.9 or more."""
    return lattice.near_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.9)


@query
def op4_line_dedup(spark, sf):
    """Which lines of each document an earlier line, of any document, makes redundant."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    gone = lines.removed_lines(docs, "doc_id", "text", threshold=2, min_chars=40, fold_chars=1)
    n = F.when(F.isnull("text"), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    here = docs.select("doc_id", F.xxhash64("text").alias("_hash"), n.alias("n_lines"))
    gone = gone.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_text_hash"), "removed")
    met = here.join(gone, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_text_hash")), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return met.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


@query
def op5_license_scan(spark, sf):
    """License templates in all documents: name:start:end:coverage, comma-joined."""
    found = licenses.scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    each = F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"), m["coverage"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(each, ",").alias("licenses"))


@query
def op6_simhash_neardup(spark, sf):
    """SimHash classes of all documents: 4-word shingles, 4 bits."""
    found = simhash.components(table(spark, sf, "documents"), "doc_id", "text", width=4, max_distance=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_quality_rules(spark, sf):
    """All measures of all documents, and the verdict of the cascade."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    order = quality.order_rules(quality.estimate(docs))
    judged = quality.cascade(quality.with_measures(docs), "text", order, ready=list(quality.MEASURES))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.isnull("rejected_by").alias("kept"),
    )


@query
def op8_html_extraction(spark, sf):
    """The main text of all pages."""
    found = html.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    text = F.col("main_text")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


@query
def op9_lm_scores(spark, sf):
    """Pseudo-likelihood of all documents under a network trained on all of them."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    met = masked_lm.met_words(docs)
    counts = masked_lm.count_words(met)
    common = masked_lm.common_words(counts, masked_lm.Shape().known)
    texts, path = masked_lm.class_table(docs, common)
    _, weights = masked_lm.train(docs, common=common, texts=texts)
    found = masked_lm.score(docs, common, weights, counts=counts, met=met, texts=texts)
    remove_table(spark, path)
    return found.select("doc_id", "n_words", "log_prob", "mean_log_prob")


def tokenizer_path() -> str:
    """The tokenizer file of the packing query; ``MASKFLOW_TOKENIZER`` names another."""
    import os

    if "MASKFLOW_TOKENIZER" in os.environ:
        return os.environ["MASKFLOW_TOKENIZER"]
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op10_pack_sequences(spark, sf):
    """All documents packed into sequences of at most 2,048 tokens."""
    return packing.pack(table(spark, sf, "documents"), tokenizer_path(), "doc_id", "text", tokens=2048)


@query
def op11_conversation_trie(spark, sf):
    """Trie nodes of all conversations, each with its first turns taken from the first of its five."""
    turns = conversation_trie.number_turns(table(spark, sf, "conversations"))
    conv = F.col("conv_id")
    turns, convs = conversation_trie.rebuild(turns, F.crc32(conv.cast("string").cast("binary")) % 9, conv - conv % 5)
    nodes, ends = conversation_trie.trie(turns, convs)
    hashes = conversation_trie.hash_ends(conversation_trie.node_ends(ends))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.join(hashes, conversation_trie.KEY, "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("sha256", none).alias("ends_sha256"),
    )


@query
def op12_periodic_runs(spark, sf):
    """Runs of the words of all documents, a tenth of which get a tail that repeats itself."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    tail = periodic.repeat_tail(F.col("text"), F.floor(h / 10))
    docs = table(spark, sf, "documents").select("doc_id", F.when(h % 10 == 0, tail).otherwise(F.col("text")).alias("text"))
    found = periodic.find_runs(docs).withColumn("best", periodic.longest_run(F.col("runs")))
    each = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.concat(F.array_join(each, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op13_pack_lengths(spark, sf):
    """All documents packed into windows of 4,096 tokens by combinations of their lengths."""
    return length_packing.pack_lengths(table(spark, sf, "documents"), tokenizer_path(), "doc_id", "text", tokens=4096, end_id=2)
