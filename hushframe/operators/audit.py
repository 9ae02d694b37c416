"""Audit events: metadata only, never content, prompts or found values."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.modes import PrivacyMode, parse_mode

EVENT_COLUMNS = ("event", "dataset", "mode", "subject", "detail", "amount")
AUDIT_SCHEMA = "event string, dataset string, mode string, subject string, detail string, amount bigint"


def _event(df: DataFrame, event: str, dataset: Column, mode: Column, subject: Column, detail: Column, amount: Column):
    return df.select(
        F.lit(event).alias("event"),
        dataset.cast("string").alias("dataset"),
        mode.cast("string").alias("mode"),
        subject.cast("string").alias("subject"),
        detail.cast("string").alias("detail"),
        amount.cast("bigint").alias("amount"),
    )


def file_loaded(catalog: DataFrame) -> DataFrame:
    return _event(catalog, "file_loaded", F.col("path"), F.lit(None), F.col("extension"), F.lit(None), F.col("size_bytes"))


def profiling_completed(counts: DataFrame, dataset: str, kind: str) -> DataFrame:
    """`counts` is the one-row output of the counters of a table or of a text."""
    return _event(
        counts, "profiling_completed", F.lit(dataset), F.lit(None), F.lit(kind), F.lit(None), F.col(counts.columns[0])
    )


def detection_summary(
    findings: DataFrame, mode: str | PrivacyMode, scanned: DataFrame | None = None, quarantine: DataFrame | None = None
) -> DataFrame:
    """Totals per dataset and type; a dataset of `scanned` without findings has one event that says so.

    One with records in the `quarantine` is not called clean: what they mean is not known.
    """
    totals = findings.groupBy("dataset", "pii_type").agg(F.count(F.lit(1)).alias("total"))
    if scanned is not None:
        clean = scanned.select("dataset").distinct().join(findings.select("dataset").distinct(), "dataset", "left_anti")
        totals = totals.unionByName(clean.select("dataset", F.lit(None).cast("string").alias("pii_type"), F.lit(0).cast("bigint").alias("total")))
    flag = F.when(F.col("total") > 0, "has_pii=true").otherwise("has_pii=false")
    if quarantine is not None:
        doubtful = quarantine.select("dataset", F.lit(True).alias("doubtful")).distinct()
        totals = totals.join(doubtful, "dataset", "left")
        flag = F.when((F.col("total") == 0) & F.col("doubtful"), "has_pii=unknown").otherwise(flag)
    return _event(
        totals, "pii_detection", F.col("dataset"), F.lit(parse_mode(mode).value), F.col("pii_type"), flag, F.col("total")
    )


def quarantined(quarantine: DataFrame, mode: str | PrivacyMode) -> DataFrame:
    """Records per dataset and reason; a record with several reasons counts for each. Their texts stay out."""
    totals = quarantine.select("dataset", F.explode("reasons").alias("reason")).groupBy("dataset", "reason").agg(F.count(F.lit(1)).alias("total"))
    return _event(totals, "records_quarantined", F.col("dataset"), F.lit(parse_mode(mode).value), F.col("reason"), F.lit(None), F.col("total"))


def anonymization_completed(replaced: DataFrame, dataset: str, mode: str | PrivacyMode) -> DataFrame:
    return _event(
        replaced, "anonymization_completed", F.lit(dataset), F.lit(parse_mode(mode).value), F.col("pii_type"),
        F.lit(None), F.col("replaced"),
    )


def safe_marked(safe: DataFrame) -> DataFrame:
    """One event per mark, with its column and rule but without its row."""
    return _event(
        safe, "safe_marked", F.col("dataset"), F.col("mode"), F.col("pii_type"),
        F.concat_ws("/", "column", "rule"), F.lit(1),
    )


def release_decided(decisions: DataFrame) -> DataFrame:
    """One event per request with its reason, scope and source; the prompt stays out."""
    return _event(
        decisions, "release_decided", F.col("dataset"), F.col("mode"), F.col("reason"),
        F.concat_ws("/", "scope", "source"), F.col("sample_rows"),
    )


def append(events: DataFrame, path: str, run: str | None = None, part: str = "events") -> str:
    """Add events to a log and return their run.

    A `run` (of a job, a micro-batch, ...) may add several parts. Adding a part again replaces it, so a job that is repeated
    under the same run counts once; without a run, each call is one of its own. What a broken job has written does not show,
    as files appear when the job commits.
    """
    run = run or uuid.uuid4().hex
    for name in (run, part):
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"{name!r} is no name for a run or part")
    events.select(*EVENT_COLUMNS).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}/part={part}")
    return run


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All events of a log with their `run` and `part`."""
    return spark.read.schema(f"{AUDIT_SCHEMA}, run string, part string").parquet(path)
