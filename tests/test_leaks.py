"""What must never leave in the clear, and what must not open the gate."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hushframe.operators import audit, context, gate
from hushframe.operators.anonymize_table import anonymize_table
from hushframe.operators.anonymize_text import anonymize_text
from hushframe.operators.detect import detect_cells, detect_table
from hushframe.plans import release
from hushframe.sources.catalog import file_catalog

ROOT = Path(__file__).resolve().parents[1]
MARK = "dataset string, mode string, k int, column string, pii_type string, rule string"


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "x@y.cz"), (2, "z@y.cz")], "k int, mail string")


@pytest.mark.parametrize(("dataset", "mode", "kept"), [("other", "Strict", 2), ("people", "Relaxed", 2), (None, None, 2), ("people", "Strict", 1)])
def test_marks_count_for_their_dataset_and_mode_only(spark, as_of, people, dataset, mode, kept):
    safe = spark.createDataFrame([(dataset, mode, 1, "mail", "EMAIL", "regex")], MARK)
    rule = detect_table(people, ["k"], "strict", as_of).first()["rule"]
    safe = safe.withColumn("rule", F.lit(rule))
    assert detect_cells(people, ["k"], "strict", as_of, safe=safe, dataset="people").count() == kept
    table = anonymize_table(people, ["k"], "strict", as_of, safe=safe, dataset="people").table
    assert sum("@" in r["mail"] for r in table.collect()) == 2 - kept
    payload = release.release_table(people, ["k"], "strict", as_of, "schema+stats+sample", F.lit("t"), "people", safe).payload.first()["payload"]
    assert payload.count("@") == 2 - kept
    lines = safe.select("dataset", "mode", "k", F.lit(1).alias("line_no"), "pii_type", F.lit("regex_text").alias("rule"))
    texts = anonymize_text(people, "mail", "strict", as_of, lines, ["k"], "people")
    assert sum("@" in r["mail"] for r in texts.collect()) == 2 - kept


def test_marks_without_a_dataset_are_refused(spark, as_of, people):
    safe = spark.createDataFrame([(1, "mail", "EMAIL", "regex")], "k int, column string, pii_type string, rule string")
    with pytest.raises(ValueError):
        anonymize_table(people, ["k"], "strict", as_of, safe=safe)


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, 0])
def test_null_and_repeated_keys_are_anonymized(spark, as_of, broadcast_bytes):
    rows = [(None, "z@y.cz", "n/a"), (1, "a@y.cz", "n/a"), (1, "b@y.cz", "n/a"), (None, None, "n/a")]
    df = spark.createDataFrame(rows, "k int, mail string, note string")
    got = anonymize_table(df, ["k"], "strict", as_of, broadcast_bytes=broadcast_bytes, order_columns=True).table
    assert got.columns == ["k", "mail", "note", "_order_0"]
    assert sorted(r["mail"] or "" for r in got.collect()) == ["", "EMAIL_1", "EMAIL_2", "EMAIL_3"]


def test_only_found_cells_travel(spark, as_of):
    df = spark.range(2000).select("id", F.when(F.col("id") % 100 == 0, F.concat(F.lit("u"), "id", F.lit("@b.cz"))).otherwise("n/a").alias("mail"))
    table = anonymize_table(df, ["id"], "strict", as_of, broadcast_bytes=0).table
    table.collect()
    text = table._jdf.queryExecution().executedPlan().toString()
    assert table.where("mail like 'EMAIL%'").count() == 20 and table.where("mail = 'n/a'").count() == 1980
    assert "n/a" not in text


def test_nested_and_binary_columns_stay_inside(spark, as_of):
    df = spark.createDataFrame([(1, "a", ["x@y.cz"], bytearray(b"x@y.cz"), {"m": "x@y.cz"})], "k int, s string, a array<string>, b binary, m map<string,string>")
    assert context.sample_rows(df, ["k"], "relaxed").columns == ["k", "s", "_sample_order_0"]
    payload = release.release_table(df, ["k"], "strict", as_of, "schema+stats+sample", F.lit("t")).payload.first()["payload"]
    assert "@" not in payload


def test_null_flags_never_open_the_gate(spark):
    schema = "i int, submitted boolean, prompt string, has_pii boolean, use_anonymized boolean, scanned boolean, want string"
    rows = [
        (1, None, "a", False, False, True, "submit_not_clicked"), (2, True, "a", True, None, True, "pii_requires_anonymization"),
        (3, True, "a", None, False, True, "pii_requires_anonymization"), (4, True, "a", None, True, None, "not_scanned"),
        (5, True, "a", False, None, True, "ok"),
    ]
    assert gate.release_decisions(spark.createDataFrame(rows, schema)).where("reason <> want").count() == 0
    flags = spark.createDataFrame([(None, None, None), (False, None, None)], "has_pii boolean, wants_anonymized boolean, anonymized_available boolean")
    got = {(r["source"], r["source_missing"]) for r in gate.release_source(flags).collect()}
    assert got == {("anonymized", True), ("original", False)}


def test_never_scanned_is_not_clean(spark):
    requests = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "dataset string")
    found, scanned = requests.where("dataset = 'a'"), requests.where("dataset in ('a', 'b')")
    got = {r["dataset"]: (r["has_pii"], r["scanned"]) for r in gate.with_pii_state(requests, found, scanned).collect()}
    assert got == {"a": (True, True), "b": (False, True), "c": (None, False), None: (None, False)}


def test_clean_datasets_leave_an_event(spark, as_of, people):
    scanned = spark.createDataFrame([("people",), ("clean",)], "dataset string")
    events = audit.detection_summary(detect_table(people, ["k"], "strict", as_of, "people"), "strict", scanned).collect()
    assert {(e["dataset"], e["subject"], e["detail"], e["amount"]) for e in events} == {("people", "EMAIL", "has_pii=true", 2), ("clean", None, "has_pii=false", 0)}


def test_row_keys_may_hold_dots(spark, as_of):
    df = spark.createDataFrame([(1, "x@y.cz")], "`a.b` int, mail string")
    assert detect_table(df, ["a.b"], "strict", as_of).first()["a.b"] == 1
    assert anonymize_table(df, ["a.b"], "strict", as_of, broadcast_bytes=0).table.first()["mail"] == "EMAIL_1"


def test_a_file_is_no_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert file_catalog(spark, str(tmp_path)).count() == 1
    assert file_catalog(spark, str(tmp_path / "a.txt")).count() == 0
    assert file_catalog(spark, str(tmp_path / "none")).count() == 0


def test_a_session_without_a_folder_gets_one(tmp_path):
    """In a process of its own, with an empty configuration."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "import hushframe.storage as s\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', s.written(spark.range(3), 'x').count(), s.shared_folder(spark) == s.shared_folder(spark))\n"
    )
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=200, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path)})
    assert "rows 3 True" in run.stdout, run.stderr[-800:]
