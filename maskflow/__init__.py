"""Masking and restoring of sensitive text as Spark table and stream operators."""

from maskflow.functions.detect import detect, has_pii
from maskflow.functions.patterns import ENTITIES
from maskflow.functions.restore import holdback_length, unredact, unredact_tokens
from maskflow.functions.sql import register as register_sql_functions
from maskflow.operators.completion import attach_responses, build_messages, complete_with
from maskflow.operators.holdback import full_answers, release_chunks
from maskflow.operators.masking import (
    entity_totals,
    hit_rows,
    mask_column,
    mask_fields,
    mask_requests,
    vault,
)
from maskflow.operators.vaults import unredact_with_vault
from maskflow.plans.requests import Session, preview, process_csv, process_requests, summarize
from maskflow.sources.requests import (
    normalize_text,
    number_requests,
    read_requests,
    read_requests_stream,
    require_columns,
)
from maskflow.sources.sinks import write_results, write_vault
from maskflow.streaming.events import process_requests_stream, restore_stream, stream_summary

__all__ = [
    "ENTITIES",
    "Session",
    "attach_responses",
    "build_messages",
    "complete_with",
    "detect",
    "entity_totals",
    "full_answers",
    "has_pii",
    "hit_rows",
    "holdback_length",
    "mask_column",
    "mask_fields",
    "mask_requests",
    "normalize_text",
    "number_requests",
    "preview",
    "process_csv",
    "process_requests",
    "process_requests_stream",
    "read_requests",
    "read_requests_stream",
    "register_sql_functions",
    "release_chunks",
    "require_columns",
    "restore_stream",
    "stream_summary",
    "summarize",
    "unredact",
    "unredact_tokens",
    "unredact_with_vault",
    "vault",
    "write_results",
    "write_vault",
]
