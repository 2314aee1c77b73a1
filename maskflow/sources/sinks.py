"""Sinks for results and the vault."""

from __future__ import annotations

from pyspark.sql import DataFrame

SENSITIVE = ("original_system", "original_user", "mappings", "final_response", "entries")


def write_results(
    results: DataFrame, path: str, keep_originals: bool = False, mode: str = "errorifexists"
) -> None:
    """Write result records as Parquet; the order is in ``request_num``.

    Columns that hold originals are left out unless asked for.
    """
    kept = results if keep_originals else results.drop(*SENSITIVE)
    kept.write.mode(mode).parquet(path)


def write_vault(vault: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the placeholder -> original table to a path the caller protects."""
    vault.write.mode(mode).parquet(path)
