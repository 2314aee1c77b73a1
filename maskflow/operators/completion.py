"""The completion step: messages, recorded answers, calls of a user function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskflow.session import materialize

CALL_FAILED = "Completion call failed: "
STREAM_FAILED = "Completion streaming call failed: "
NO_ANSWER = "no answer for this request"

Complete = Callable[[str, str], "str | None"]


def build_messages(system: Column, user: Column) -> Column:
    """The two chat messages of a request, system first."""
    return F.array(
        *[
            F.struct(F.lit(role).alias("role"), text.alias("content"))
            for role, text in (("system", system), ("user", user))
        ]
    )


def wrap_error(cause: Column, prefix: str = CALL_FAILED) -> Column:
    """Prefix an error text; no cause, no error."""
    return F.concat(F.lit(prefix), cause)


def attach_responses(masked: DataFrame, responses: DataFrame) -> DataFrame:
    """Add ``response`` and ``error`` from recorded answers.

    ``responses`` has request_num (unique), response and error. An answer that
    is null is a success; a request without a row gets an error.
    """
    answers = responses.select("request_num", "response", "error", F.lit(True).alias("_present"))
    joined = masked.join(answers, "request_num", "left")
    missing = F.when(F.col("_present").isNull(), F.lit(NO_ANSWER))
    return joined.withColumn("error", F.coalesce("error", missing)).drop("_present")


def complete_with(
    masked: DataFrame,
    connect: Callable[[str], Complete],
    model: str = "default",
    prefix: str = CALL_FAILED,
) -> DataFrame:
    """Call a user function for each request: request_num, response, error.

    ``connect(model)`` runs once per task and returns ``complete(system,
    user)``. Only the key and the masked texts reach the Python worker. One
    failing call gives an error row and leaves the others alone. The answers
    are written once, because a second call may answer differently.
    """

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = connect(model)
        for batch in batches:
            answers, errors = [], []
            for system, user in zip(batch["redacted_system"], batch["redacted_user"]):
                answer, error = None, None
                try:
                    answer = complete(system, user)
                except Exception as cause:
                    error = f"{prefix}{cause}"
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame(
                {
                    "request_num": batch["request_num"],
                    "response": pd.Series(answers, dtype=object, index=batch.index),
                    "error": pd.Series(errors, dtype=object, index=batch.index),
                }
            )

    seen = masked.select("request_num", "redacted_system", "redacted_user")
    answers = seen.mapInPandas(call, "request_num long, response string, error string")
    return materialize(answers, "answers")


def nonempty_chunks(chunks: DataFrame) -> DataFrame:
    """Drop chunks that carry no text."""
    return chunks.filter(F.col("content").isNotNull() & (F.col("content") != ""))
