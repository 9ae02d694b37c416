"""The release gate: which requests may go out, and in which version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.text import strip

OK = "ok"


def with_pii_state(requests: DataFrame, findings: DataFrame, scanned: DataFrame, key: str = "dataset") -> DataFrame:
    """Add `has_pii` from the (effective) findings of the dataset that a request names, and `scanned`.

    `scanned` names the datasets that detection has seen, with or without findings. For any other dataset, and for
    none, `has_pii` is null and `scanned` false: nobody knows.
    """
    known = scanned.select(key).distinct().withColumn("scanned", F.lit(True))
    flagged = findings.select(key).distinct().withColumn("has_pii", F.lit(True))
    joined = requests.join(known, key, "left").join(flagged, key, "left")
    seen = F.coalesce("scanned", F.lit(False))
    return joined.withColumns({"scanned": seen, "has_pii": F.when(seen, F.coalesce("has_pii", F.lit(False)))})


def _flag(name: str, missing: bool) -> Column:
    """A flag whose null is read as the value that keeps data back."""
    return F.coalesce(F.col(name), F.lit(missing))


def release_source(requests: DataFrame) -> DataFrame:
    """Add `source`: the anonymized version if the data has findings or the user asks for it.

    Reads `has_pii`, `wants_anonymized` and `anonymized_available`. Data of which nothing is known counts as having
    findings, an unknown anonymized version as missing.
    """
    anonymized = _flag("has_pii", True) | _flag("wants_anonymized", False)
    return requests.withColumn("source", F.when(anonymized, "anonymized").otherwise("original")).withColumn(
        "source_missing", anonymized & ~_flag("anonymized_available", False)
    )


def release_decisions(requests: DataFrame) -> DataFrame:
    """Add `reason`, the first rule that fails, or `ok`.

    Reads `submitted`, `prompt`, `has_pii` and `use_anonymized`, and `source_missing` and `scanned` if they are
    there. A null flag never opens the gate.
    """
    reason = F.when(~_flag("submitted", False), "submit_not_clicked")
    if "scanned" in requests.columns:
        reason = reason.when(~_flag("scanned", False), "not_scanned")
    if "source_missing" in requests.columns:
        reason = reason.when(_flag("source_missing", True), "anonymized_missing")
    reason = (
        reason.when(strip(F.coalesce("prompt", F.lit(""))) == "", "empty_prompt")
        .when(_flag("has_pii", True) & ~_flag("use_anonymized", False), "pii_requires_anonymization")
        .otherwise(OK)
    )
    return requests.withColumn("reason", reason)


def released(decisions: DataFrame) -> DataFrame:
    """The requests that may go out."""
    return decisions.where(F.col("reason") == OK)


def blocked(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("reason") != OK)
