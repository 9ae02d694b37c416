import json

import pytest
from pyspark.sql import functions as F

from hushframe.operators import audit, context, conversations, gate
from hushframe.operators.anonymize_table import anonymize_table
from hushframe.operators.detect import detect_table, detect_text
from hushframe.plans import release


def test_id_columns_and_sample_limits(spark):
    df = spark.range(250).select(
        F.concat(F.lit("user_"), "id").alias("user_id"), F.lit("Praha").alias("city"), F.col("id").alias("value"),
        F.lit(None).cast("string").alias("empty_id"), (F.col("id") % 200).alias("other_id"),
    )
    assert context.columns_to_drop(df) == ["user_id"]
    listed = {r["column"]: (r["non_null"], r["distinct_values"], r["dropped"]) for r in context.id_like_columns(df).collect()}
    assert listed == {"user_id": (250, 250, True), "empty_id": (0, 0, False), "other_id": (250, 200, False)}
    assert context.columns_to_drop(df.limit(49)) == []
    for mode, rows in (("strict", 100), ("balanced", 200), ("relaxed", 300)):
        one = context.table_context(df, ["value"], mode, "schema+stats+sample").first()
        assert one["sample_row_count"] == min(rows, 250)
        assert [r["value"] for r in one["sample_rows"]] == list(range(min(rows, 250)))
        assert ("user_id" in one["sample_rows"][0].asDict()) == (mode != "strict")


def test_scopes(spark):
    df = spark.createDataFrame([(1, "x", 1.5), (2, None, None), (2, None, None)], "k int, s string, n double")
    assert context.table_context(df, ["k"], "x", "schema").first()["profile"].asDict(True) == {
        "schema": [{"column": "k", "dtype": "int32"}, {"column": "s", "dtype": "object"}, {"column": "n", "dtype": "float64"}]
    }
    profile = context.table_context(df, ["k"], "strict", "schema+stats").first()["profile"].asDict(True)
    assert profile["row_count"] == 3 and profile["column_count"] == 3 and profile["duplicate_rows"] == 1
    assert profile["missing_by_column"] == {"k": 0, "s": 2, "n": 2}
    assert profile["numeric_stats"]["n"] == {"min": 1.5, "max": 1.5, "mean": 1.5, "median": 1.5}
    assert "top_values" not in profile
    with pytest.raises(ValueError):
        context.table_context(df, ["k"], "strict", "everything")


def test_text_context_profiles_the_released_version(spark, as_of):
    df = spark.createDataFrame([(1, "napsal novak@firma.cz\nnovak@firma.cz"), (2, "")], "d int, text string")
    released = context.released_text(df, "text", "strict", as_of)
    one = context.text_context(released, ["d"], "text", "strict", "schema+stats+sample", released="released")
    row = one.where("d = 1").first()
    assert row["sample_rows"] == ["napsal EMAIL_1", "EMAIL_1"] and row["sample_row_count"] == 2
    assert "novak" not in str(row)
    original = context.text_context(released, ["d"], "text", "strict", "schema", "released", "original").where("d = 1").first()
    assert {k["term"] for k in original["profile"]["keywords"]} == {"napsal", "novak", "firma"}
    assert one.where("d = 2").first()["sample_rows"] == []


def test_payload_guard(spark):
    df = spark.range(2000).select("id", F.repeat(F.lit("X"), F.lit(5000)).alias("description"))
    task = F.lit("čti")
    ctx = context.table_context(df, ["id"], "strict", "schema+stats+sample")
    row = context.release_payload(ctx, task).first()
    decoded = json.loads(row["payload"])
    assert row["truncated"] and not row["still_over"] and "sample" not in decoded["dataset"]
    assert row["payload_bytes"] == len(json.dumps(decoded, indent=2, ensure_ascii=False).encode())
    row = context.release_payload(ctx, task, 10**7).first()
    decoded = json.loads(row["payload"])
    assert not row["truncated"] and len(decoded["dataset"]["sample"]) == 100
    assert list(decoded) == ["task", "dataset", "analysis_scope"] and "schema" not in decoded["dataset"]["stats"]
    assert row["payload_bytes"] == len(json.dumps(decoded, indent=2, ensure_ascii=False).encode())
    assert context.release_payload(ctx, task, 10).first()["still_over"]


def test_gate(spark):
    rows = [
        (1, False, "Ahoj", False, False, "submit_not_clicked"), (2, True, " \n", True, False, "empty_prompt"),
        (3, True, None, False, False, "empty_prompt"), (4, True, "Ahoj", True, False, "pii_requires_anonymization"),
        (5, True, "Ahoj", True, True, "ok"), (6, True, "Ahoj", False, False, "ok"),
    ]
    df = spark.createDataFrame(rows, "i int, submitted boolean, prompt string, has_pii boolean, use_anonymized boolean, want string")
    decided = gate.release_decisions(df)
    assert decided.where("reason <> want").count() == 0
    assert sorted(r["i"] for r in gate.released(decided).collect()) == [5, 6]
    assert gate.blocked(decided).count() == 4
    rows = [(1, True, False, False), (2, False, True, True), (3, False, False, False)]
    sourced = gate.release_source(spark.createDataFrame(rows, "i int, has_pii boolean, wants_anonymized boolean, anonymized_available boolean"))
    assert [(r["source"], r["source_missing"]) for r in sourced.orderBy("i").collect()] == [
        ("anonymized", True), ("anonymized", False), ("original", False),
    ]


@pytest.mark.parametrize("long_rows", [10**6, 3])
def test_conversation_order(spark, long_rows):
    roles = {1: "suaua", 2: "aa", 3: "uuaau" * 4, 4: "a" * 9}
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(c, t, names[r]) for c, text in roles.items() for t, r in enumerate(text)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string").repartition(5)
    got = {}
    for r in conversations.newest_first(df, long_rows=long_rows).orderBy("conv_id", "position").collect():
        got.setdefault(r["conv_id"], []).append(r["turn"])
    for c, text in roles.items():
        groups = []
        for t, r in enumerate(text):
            if r == "u" or not groups:
                groups.append([t])
            else:
                groups[-1].append(t)
        assert got[c] == [t for g in reversed(groups) for t in g]


def test_conversation_append_and_content(spark):
    messages = spark.createDataFrame([(1, 0, "user", "a")], "conv_id int, turn int, role string, text string")
    replies = spark.createDataFrame([(1, " b\n", "c"), (2, "d", "e ")], "conv_id int, prompt string, reply string")
    rows = conversations.append_pair(messages, replies).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in rows] == [
        (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "user", "d"), (2, 1, "assistant", "e "),
    ]
    stored = ["plain", '[{"text": "a"}, "b", {"text": "č "}]', "[not json", '{"text": "x"}']
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stored)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(conversations.normalise_content(F.col("s"))).collect()]
    assert got == ["plain", "a\nb\nč", "[not json", '{"text": "x"}']


def test_audit_is_metadata_only(spark, as_of, tmp_path):
    df = spark.createDataFrame([(1, "secret@b.cz", "tajné jméno")], "k int, mail string, name string")
    found = detect_table(df, ["k"], "strict", as_of, "people")
    counts = anonymize_table(df, ["k"], "strict", as_of).dictionary.replaced_counts()
    decisions = spark.createDataFrame([("people", "Strict", "ok", "schema", "anonymized", 0)], "dataset string, mode string, reason string, scope string, source string, sample_rows int")
    safe = spark.createDataFrame([("people", "Strict", 1, "name", "NAME", "column_name_heuristic")], "dataset string, mode string, k int, column string, pii_type string, rule string")
    for events in (audit.detection_summary(found, "strict"), audit.anonymization_completed(counts, "people", "strict"),
                   audit.release_decided(decisions), audit.safe_marked(safe),
                   audit.profiling_completed(spark.range(1).select(F.lit(1).alias("row_count")), "people", "csv"),
                   audit.file_loaded(spark.createDataFrame([("/d/a.csv", ".csv", 3)], "path string, extension string, size_bytes bigint"))):
        audit.append(events, str(tmp_path / "audit"))
    log = audit.read_log(spark, str(tmp_path / "audit"))
    assert log.columns == ["event", "dataset", "mode", "subject", "detail", "amount", "run", "part"]
    text = str(log.collect())
    assert log.count() == 8 and "secret" not in text and "tajné" not in text


def test_a_repeated_run_is_in_the_log_once(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([("e", "d", None, "s", None, 1)] * 2, audit.AUDIT_SCHEMA)
    assert audit.append(events, path, "job-1") == "job-1"
    audit.append(events, path, "job-1")
    audit.append(events, path, "job-1", "more")
    audit.append(events, path, "job-2")
    assert audit.append(events, path) != audit.append(events, path)
    counts = {(r["run"], r["part"]): r["count"] for r in audit.read_log(spark, path).groupBy("run", "part").count().collect()}
    assert len(counts) == 5 and set(counts.values()) == {2} and ("job-1", "more") in counts
    with pytest.raises(ValueError):
        audit.append(events, path, "a/b")


def test_parts_of_a_content_that_are_no_texts(spark):
    stored = ['[true, 1.0, {"text": null}, null, 1, -2.50, 1e3, "x", {"text": false}, {"text": 3}]', "[]", "[12345678901234567890123, 0.1]"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stored)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(conversations.normalise_content(F.col("s"))).collect()]
    assert got == ["True\n1.0\nNone\nNone\n1\n-2.5\n1000.0\nx\nFalse\n3", "", "12345678901234567890123\n0.1"]


def test_release_of_a_table(spark, as_of):
    df = spark.range(300).select(
        (F.lit(10000) + F.col("id")).alias("account_id"), F.concat(F.lit("u"), F.col("id") % 7, F.lit("@b.cz")).alias("mail"),
        (F.col("id") * 2).alias("value"),
    ).repartition(4)
    out = release.release_table(df, ["account_id"], "strict", as_of, "schema+stats+sample", F.lit("t"))
    decoded = json.loads(out.payload.first()["payload"])["dataset"]
    # The key holds findings itself: it leaves as tokens, and the sample keeps its order.
    assert [r["value"] for r in decoded["sample"]] == [2 * i for i in range(100)]
    assert decoded["sample"][3] == {"mail": "EMAIL_4", "value": 6} and "_order_0" not in str(decoded)
    assert decoded["stats"]["row_count"] == 300 and out.anonymized.table.columns == df.columns
    explored = release.explore_table(df, ["account_id"], "strict", as_of, "d")
    assert explored.findings.count() == 600 and explored.effective.count() == 600


def test_results_do_not_depend_on_partitions(spark, as_of):
    df = spark.range(200).select("id", F.concat(F.lit("u"), F.col("id") % 11, F.lit("@b.cz")).alias("name"))
    tables = [
        sorted(tuple(r) for r in anonymize_table(df.repartition(n), ["id"], "strict", as_of).table.collect()) for n in (1, 9)
    ]
    assert tables[0] == tables[1]


def test_plans_stay_in_the_jvm(spark, as_of):
    df = spark.createDataFrame([(1, "a@b.cz", "text")], "k int, mail string, text string")
    for result in (detect_table(df, ["k"], "strict", as_of), detect_text(df, ["k"], "text", "strict", as_of)):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan


def test_detection_runs_on_a_stream(spark, as_of, tmp_path):
    spark.createDataFrame([(1, "a@b.cz"), (2, "x")], "k int, mail string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, mail string").parquet(str(tmp_path / "in"))
    found = detect_table(stream, ["k"], "strict", as_of)
    run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert [r["raw_value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a@b.cz"]
