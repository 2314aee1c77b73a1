"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, folder of tables), works on all that its
predecessor kept, and returns a DataFrame; ``run`` writes each stage's rows to
the shared folder and reads them back as the next stage's documents. All but
the last stage return the columns of documents, whatever others there are.

Defined results, for all stages: null and empty texts have no words and go
with the first stage; an empty table gives no rows; rows with equal ids are
separate rows, but equal in all they count as one line-by-line edit; columns
beside id, text and source are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.llm import lines, mixing, packing, quality, simhash
from maskflow.llm.common import remove_table, word_count, write_table
from maskflow.llm.queries import tokenizer_path


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, if there is such a column, made true to the text again."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs, "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line equals or nearly equals."""
    clean = lines.dedup_lines(docs, "doc_id", "text", threshold=2, min_chars=40, fold_chars=1)
    return _sized(clean if "removed" in docs.columns else clean.drop("removed"))


def simhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs, "doc_id", "text", width=4, max_distance=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    mixed = mixing.mix(docs, "doc_id", "source", word_count(F.col("text")))
    return mixed if "position" in docs.columns else mixed.drop("position")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2,048 tokens."""
    return packing.pack(docs, tokenizer_path(), "doc_id", "text", tokens=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_neardup", simhash_neardup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL has neither the fingerprints nor the tokenizer; the operators are tested one by one against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = write_table(stage(spark, docs, sf_dir), name)
        if before:
            remove_table(spark, before)
        before = path
    return docs
