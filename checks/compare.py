"""Run queries next to their SQL: python -m checks.compare [sf] [name ...]."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples, columns by name, every null as None."""
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(tuple, rows.itertuples(index=False)), key=repr)


def kinds(con, sql: str) -> dict[str, str]:
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}


SAME = {"string": "VARCHAR", "bigint": "BIGINT", "boolean": "BOOLEAN", "int": "INTEGER"}


def compare(spark: SparkSession, con, folder: str, name: str) -> str:
    """'' if the results agree, else what differs."""
    df = QUERIES[name](spark, folder)
    got = df.toPandas()
    if name not in ORACLES:
        return "" if len(got) else "no rows"
    sql = ORACLES[name]
    want = con.execute(sql).fetchdf()
    types = {c: SAME.get(t, t) for c, t in df.dtypes}
    told = kinds(con, sql)
    if types != told:
        return f"types {types} / {told}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return ""
    left = [r for r in a if r not in set(b)][:2] if len(a) < 100_000 else a[:1]
    right = [r for r in b if r not in set(a)][:2] if len(b) < 100_000 else b[:1]
    return f"{len(a)} / {len(b)} rows; only spark {left}; only sql {right}"


def main() -> int:
    sf, names = "0.01", list(QUERIES)
    args = sys.argv[1:]
    if args and args[0].replace(".", "").isdigit():
        sf = args.pop(0)
    names = args or names
    folder = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as cause:
            problem = f"{type(cause).__name__}: {str(cause)[:600]}"
        bad += bool(problem)
        print(f"{name:28s} {time.time() - start:6.1f}s {'ok' if not problem else problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
