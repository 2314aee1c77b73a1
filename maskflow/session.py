"""Session helpers: the shared folder and tables written into it."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="maskflow-")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the cluster.

    Only a local session (tests, notebooks) may lack the setting; it then gets
    a temporary folder. Elsewhere a machine-local folder would lose data with
    the machine, so a missing setting is an error.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if path:
        return path.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    return _local_dir()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/maskflow/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, pins values that a second run could change, and gives
    the optimizer the real size. The table outlives any lost executor.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it has fewer input splits than there are.

    Patterns are costly per character, so a few small files would keep one
    core busy and the others idle. Large inputs have more splits than cores
    and pass as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
