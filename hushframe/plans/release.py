"""From a table or a corpus to its release payload."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame

from hushframe.modes import ContextScope, PrivacyMode, parse_mode
from hushframe.operators import report
from hushframe.operators.anonymize_table import AnonymizedTable, anonymize_table
from hushframe.operators.context import (
    PAYLOAD_LIMIT_BYTES, release_payload, released_text, table_context, table_profile, text_context,
)
from hushframe.operators.detect import detect_table
from hushframe.storage import written


@dataclass
class TableExploration:
    """What exploring a table gives: its profile, all findings, and those that count after the safe marks."""

    profile: DataFrame
    findings: DataFrame
    effective: DataFrame


def explore_table(
    df: DataFrame,
    row_key: Sequence[str],
    mode: str | PrivacyMode,
    as_of: date | str | None = None,
    dataset: str = "table",
    safe: DataFrame | None = None,
) -> TableExploration:
    """Profile and findings of a table. The findings are written once, since several reports read them."""
    found = written(detect_table(df, row_key, mode, as_of, dataset), "findings")
    effective = found if safe is None else report.effective_findings(found, safe, list(row_key), mode)
    return TableExploration(table_profile(df), found, effective)


@dataclass
class TableRelease:
    anonymized: AnonymizedTable
    payload: DataFrame


def release_table(
    df: DataFrame,
    row_key: Sequence[str],
    mode: str | PrivacyMode,
    as_of: date | str | None,
    scope: str | ContextScope,
    task: Column,
    dataset: str = "table",
    safe: DataFrame | None = None,
    decimals: int | None = None,
    limit_bytes: int = PAYLOAD_LIMIT_BYTES,
) -> TableRelease:
    """Anonymize a table, profile the anonymized version and build its guarded payload.

    The anonymized table is written once; profile and sample read it by column.
    """
    mode = parse_mode(mode)
    anonymized = anonymize_table(df, row_key, mode, as_of, safe, order_columns=True, dataset=dataset)
    stored = written(anonymized.table, "anonymized")
    order = [c for c in stored.columns if c not in df.columns]
    context = table_context(stored, order, mode, scope, dataset, decimals, hidden=order)
    return TableRelease(AnonymizedTable(stored.drop(*order), anonymized.dictionary), release_payload(context, task, limit_bytes))


def release_texts(
    df: DataFrame,
    key: Sequence[str],
    text: str,
    mode: str | PrivacyMode,
    as_of: date | str | None,
    scope: str | ContextScope,
    task: Column,
    safe: DataFrame | None = None,
    limit_bytes: int = PAYLOAD_LIMIT_BYTES,
    dataset: str = "text",
) -> DataFrame:
    """Anonymize every text and build its guarded payload, all inside its row."""
    released = released_text(df.select(*key, text), text, mode, as_of, safe, key, dataset)
    context = text_context(released, key, text, mode, scope, released="released")
    return release_payload(context, task, limit_bytes)
