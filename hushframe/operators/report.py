"""Reports over a findings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.modes import PrivacyMode, parse_mode

# Fixed value: findings shown per report.
SHOWN_FINDINGS = 200


def totals_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pii_type").agg(F.count(F.lit(1)).alias("total"))


def columns_by_type(findings: DataFrame) -> DataFrame:
    """Distinct columns per type, sorted; the list is as long as the table is wide at most."""
    return findings.groupBy("pii_type").agg(F.array_sort(F.collect_set("column")).alias("columns"))


def rows_by_type(findings: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """Distinct rows per type, as rows: a list per type would grow with the data."""
    return findings.select("pii_type", *[F.col(f"`{k}`") for k in row_key]).distinct()


def has_pii(findings: DataFrame) -> DataFrame:
    return findings.agg((F.count(F.lit(1)) > 0).alias("has_pii"))


def effective_findings(
    findings: DataFrame, safe: DataFrame, row_key: Sequence[str], mode: str | PrivacyMode
) -> DataFrame:
    """Leave out the findings marked as safe; only the Strict mode honours the marks.

    `safe` holds `dataset`, `mode`, the row key, `column`, `pii_type` and `rule`.
    """
    mode = parse_mode(mode)
    if mode is not PrivacyMode.STRICT:
        return findings
    on = ["dataset", *row_key, "column", "pii_type", "rule"]
    marks = safe.where(F.col("mode") == mode.value).select(*[F.col(f"`{c}`").alias(f"_mark_{i}") for i, c in enumerate(on)])
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_mark_{i}")) for i, c in enumerate(on)]
    return findings.join(marks, same, "left_anti")


def masked_samples(findings: DataFrame, order: Sequence[str], limit: int = SHOWN_FINDINGS) -> DataFrame:
    """The first findings in finding order, with the masked value only."""
    return (
        findings.orderBy(*order)
        .limit(limit)
        .withColumn("confidence", F.round("confidence", 2))
        .drop("raw_value")
    )
