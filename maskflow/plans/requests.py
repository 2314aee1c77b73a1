"""User-level flows over request tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskflow.functions import patterns as P
from maskflow.functions.restore import unredact_tokens
from maskflow.operators.completion import Complete, attach_responses, complete_with
from maskflow.operators.masking import entity_totals, mask_fields, mask_requests
from maskflow.sources.requests import read_requests

RESULT_COLUMNS = (
    "request_num",
    "original_system",
    "original_user",
    "redacted_system",
    "redacted_user",
    "mappings",
    "llm_response_redacted",
    "final_response",
    "error",
)


def result_records(answered: DataFrame) -> DataFrame:
    """Result records of masked requests with ``response`` and ``error``.

    A failed request keeps only its originals and the error. Its numbers stay
    used, since numbering comes before the call.
    """
    ok = F.col("error").isNull()
    return answered.select(
        "request_num",
        "original_system",
        "original_user",
        *[F.when(ok, F.col(c)).alias(c) for c in ("redacted_system", "redacted_user", "mappings")],
        F.when(ok, F.col("response")).alias("llm_response_redacted"),
        F.when(ok, unredact_tokens(F.col("response"), F.col("mappings"))).alias("final_response"),
        "error",
    )


def process_requests(
    requests: DataFrame,
    connect: Callable[[str], Complete] | None = None,
    responses: DataFrame | None = None,
    scope: str = "session",
    model: str = "default",
    start: Mapping[str, int] | None = None,
) -> DataFrame:
    """Mask both prompts, get an answer, restore it: one result row per request.

    Answers come from calls of a user function (``connect``, see
    ``complete_with``) or from a table of recorded ``responses``.
    """
    if (connect is None) == (responses is None):
        raise ValueError("give either connect or responses")
    masked = mask_requests(requests, scope, start=start)
    answers = responses if connect is None else complete_with(masked, connect, model)
    return result_records(attach_responses(masked, answers))


def process_csv(
    spark: SparkSession,
    path: str,
    connect: Callable[[str], Complete] | None = None,
    responses: DataFrame | None = None,
    scope: str = "session",
    model: str = "default",
    multi_line: bool = True,
) -> DataFrame:
    """``process_requests`` on request CSV files."""
    requests = read_requests(spark, path, multi_line)
    return process_requests(requests, connect, responses, scope, model)


def summarize(results: DataFrame) -> DataFrame:
    """One row: total, successful, failed."""
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def preview(results: DataFrame, n: int = 100) -> DataFrame:
    """Display form: texts cut to ``n`` characters, mapping as lines.

    Sensitive, as it shows originals.
    """

    def short(name: str):
        col = F.col(name)
        cut = F.concat(F.left(col, F.lit(n)), F.lit("..."))
        return F.when(F.length(col) > n, cut).otherwise(col).alias(name)

    lines = F.transform(
        F.map_entries("mappings"), lambda e: F.concat(e["key"], F.lit(" -> "), e["value"])
    )
    return results.select(
        "request_num",
        *[
            short(c)
            for c in ("original_system", "original_user", "redacted_system", "redacted_user")
        ],
        F.coalesce(F.size("mappings") > 0, F.lit(False)).alias("has_pii"),
        F.array_join(lines, "\n").alias("mapping_lines"),
        F.col("llm_response_redacted"),
        F.col("final_response"),
        F.col("error"),
    )


class Session:
    """Counters that go on from call to call, as one redactor object has them.

    Only the three totals live on the driver. Each call adds a counting pass
    over its input.
    """

    def __init__(self, connect: Callable[[str], Complete] | None = None, model: str = "default"):
        self.connect = connect
        self.model = model
        self.counters = {e: 0 for e in P.ENTITIES}

    def _advance(self, df: DataFrame, fields: list[str]) -> dict[str, int]:
        start = dict(self.counters)
        for row in entity_totals(df, fields).collect():
            self.counters[row["entity_type"]] += row["hits"]
        return start

    def redact(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """Mask one text column; adds ``redacted_<text>`` and ``entries``."""
        start = self._advance(df, [text])
        return mask_fields(df, key, [text], "session", start=start)

    def process_requests(self, requests: DataFrame, responses: DataFrame | None = None) -> DataFrame:
        start = self._advance(requests, ["system_prompt", "prompt"])
        connect = None if responses is not None else self.connect
        return process_requests(requests, connect, responses, model=self.model, start=start)

    def process_csv(
        self, spark: SparkSession, path: str, responses: DataFrame | None = None
    ) -> DataFrame:
        return self.process_requests(read_requests(spark, path), responses)
