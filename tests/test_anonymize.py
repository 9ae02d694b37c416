"""Table and text tokens against plain sequential models."""

import random

import pytest
from pyspark.sql import functions as F

from hushframe.operators import anonymize_table as at
from hushframe.operators import anonymize_text as ax
from hushframe.operators.detect import detect_cells, detect_table, detect_text

VALUES = ["a@b.cz", " a@b.cz", "777 888 999", "850101/0012", "8501010012", "1988-05-17", "110 00", "Jan", "", None, "x",
          "19-2000145399/0800", "ul. Dlouhá 110 00"]
COLUMNS = ["name", "mail", "city", "rodne_cislo"]


def random_table(spark, seed, rows=60):
    rng = random.Random(seed)
    data = [(i, *[rng.choice(VALUES) for _ in COLUMNS], rng.choice([None, 777888999, 5])) for i in range(rows)]
    rng.shuffle(data)
    schema = "k int, " + ", ".join(f"{c} string" for c in COLUMNS) + ", n int"
    return data, spark.createDataFrame(data, schema)


def sequential(data, names, findings):
    """Replace finding by finding, each seeing what the one before has left."""
    cells = {(row[0], c): row[i] for row in data for i, c in enumerate(names)}
    maps, counts = {}, {}
    for f in findings:
        key = (f["k"], f["column"])
        known = maps.setdefault(f["pii_type"], {})
        value = str(cells[key])
        if value not in known:
            known[value] = f"{f['pii_type']}_{len(known) + 1}"
        cells[key] = known[value]
        counts[f["pii_type"]] = counts.get(f["pii_type"], 0) + 1
    return cells, maps, counts


@pytest.mark.parametrize("seed,mode,broadcast_bytes", [(1, "strict", 1 << 20), (2, "strict", 0), (3, "relaxed", 0), (4, "balanced", 1 << 20)])
def test_table_against_model(spark, as_of, seed, mode, broadcast_bytes):
    data, df = random_table(spark, seed)
    order = ["column_ord", "k", "rule_order"]
    findings = detect_table(df, ["k"], mode, as_of).orderBy(*order).collect()
    cells, maps, counts = sequential(data, df.columns, findings)
    result = at.anonymize_table(df.repartition(5), ["k"], mode, as_of, broadcast_bytes=broadcast_bytes)
    for row in result.table.collect():
        for c in df.columns:
            want = cells[(int(row["k"]), c)]
            assert row[c] == want or str(row[c]) == str(want), (row["k"], c)
    got = {}
    for r in result.dictionary.token_map().collect():
        got.setdefault(r["pii_type"], {})[r["value"]] = r["token"]
    assert got == maps
    assert {r["pii_type"]: r["replaced"] for r in result.dictionary.replaced_counts().collect()} == counts


def test_hot_and_rare_texts_meet_their_tokens(spark, as_of):
    rows = [(i, "hot@b.cz" if i % 3 else f"u{i}@b.cz") for i in range(300)]
    df = spark.createDataFrame(rows, "k int, mail string")
    dictionary = at.token_dictionary(detect_cells(df, ["k"], "strict", as_of), ["k"])
    cells = df.select("k", F.lit(1).alias("column_ord"), F.col("mail").alias("raw"), F.lit("EMAIL").alias("types"))
    got = {r["k"]: r["token"] for r in at.cell_tokens(cells, dictionary).collect()}
    assert len(got) == 300
    assert len({got[i] for i in range(300) if i % 3}) == 1
    assert len({got[i] for i in range(0, 300, 3)}) == 100


def test_composite_key_and_safe_marks(spark, as_of):
    df = spark.createDataFrame(
        [("a", 1, "x@y.cz"), ("a", 2, "x@y.cz"), ("b", 1, "z@y.cz")], "g string, k int, name string"
    )
    safe = spark.createDataFrame(
        [("a", 2, "name", "NAME", "column_name_heuristic"), ("b", 1, "name", "EMAIL", "regex_email"),
         ("b", 1, "name", "NAME", "column_name_heuristic")],
        "g string, k int, column string, pii_type string, rule string",
    ).withColumns({"dataset": F.lit("table"), "mode": F.lit("Strict")})
    marked = at.anonymize_table(df, ["g", "k"], "strict", as_of, safe=safe).table
    assert {(r["g"], r["k"]): r["name"] for r in marked.collect()} == {("a", 1): "NAME_1", ("a", 2): "EMAIL_1", ("b", 1): "z@y.cz"}
    relaxed = at.anonymize_table(df, ["g", "k"], "relaxed", as_of, safe=safe).table
    assert sorted(r["name"] for r in relaxed.collect()) == ["NAME_1", "NAME_1", "NAME_2"]


def test_untouched_columns_keep_their_type(spark, as_of):
    df = spark.createDataFrame([(1, "a@b.cz", 5, 1.5)], "k int, mail string, n int, x double")
    result = at.anonymize_table(df, ["k"], "strict", as_of).table
    assert [f.dataType.simpleString() for f in result.schema.fields] == ["int", "string", "int", "double"]
    clean = at.anonymize_table(df.drop("mail"), ["k"], "strict", as_of).table
    assert clean.collect()[0].asDict() == {"k": 1, "n": 5, "x": 1.5}


def test_released_cells_hold_no_direct_identifier(spark, as_of):
    _, df = random_table(spark, 9)
    released = at.anonymize_table(df, ["k"], "strict", as_of).table
    again = detect_table(released, ["k"], "strict", as_of).select("pii_type").distinct().collect()
    assert not {r["pii_type"] for r in again} & {"EMAIL", "PHONE", "BANK", "DOB"}


LINES = ["a@b.cz", "mail a@b.cz, xa@b.cz!", "777888999 777 888 999", "8501010012", "850101/0012 8501010012", "ul. Dlouhá 12",
         "1988-05-17 a 17.5.1988", "nothing", "", "19-2000145399/0800", "ul.", "1234567890123 777888999"]


def sequential_text(text, findings):
    pairs = sorted(((f["pii_type"], f["raw_value"]) for f in findings), key=lambda p: len(p[1]), reverse=True)
    maps, counts = {}, {}
    for pii_type, raw in pairs:
        known = maps.setdefault(pii_type, {})
        if raw not in known:
            known[raw] = f"{pii_type}_{len(known) + 1}"
            hits = text.count(raw)
            text = text.replace(raw, known[raw])
            if hits:
                counts[pii_type] = counts.get(pii_type, 0) + hits
    return text, maps, counts


@pytest.mark.parametrize("mode", ["strict", "relaxed"])
def test_texts_against_model(spark, as_of, mode):
    rng = random.Random(5)
    texts = [(i, "\n".join(rng.choice(LINES) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    df = spark.createDataFrame(texts, "d int, text string").repartition(3)
    findings = {}
    for f in detect_text(df, ["d"], "text", mode, as_of).orderBy("d", "line_no", "match_no").collect():
        findings.setdefault(f["d"], []).append(f)
    want = {d: sequential_text(t, findings.get(d, [])) for d, t in texts}
    assert {r["d"]: r["text"] for r in ax.anonymize_text(df, "text", mode, as_of).collect()} == {d: w[0] for d, w in want.items()}
    maps = {}
    for r in ax.text_dictionary(df, ["d"], "text", mode, as_of).collect():
        maps.setdefault(r["d"], {}).setdefault(r["pii_type"], {})[r["raw"]] = r["token"]
    assert maps == {d: w[1] for d, w in want.items() if w[1]}
    counts = {}
    for r in ax.replaced_counts(df, "text", mode, as_of, ["d"]).collect():
        counts.setdefault(r["d"], {})[r["pii_type"]] = r["replaced"]
    assert counts == {d: w[2] for d, w in want.items() if w[2]}


def test_safe_marks_in_texts(spark, as_of):
    df = spark.createDataFrame([(1, "777888999\n777888999 a@b.cz"), (2, "777888999")], "d int, text string")
    safe = spark.createDataFrame([(1, 1, "PHONE", "regex_text"), (1, 2, "PHONE", "regex_text")], "d int, line_no int, pii_type string, rule string")
    safe = safe.withColumns({"dataset": F.lit("text"), "mode": F.lit("Strict")})
    got = {r["d"]: r["text"] for r in ax.anonymize_text(df, "text", "strict", as_of, safe, ["d"]).collect()}
    assert got == {1: "777888999\n777888999 EMAIL_1", 2: "PHONE_1"}
    # A value that is safe on one line is replaced everywhere as long as another line is not.
    got = {r["d"]: r["text"] for r in ax.anonymize_text(df, "text", "strict", as_of, safe.where("line_no = 1"), ["d"]).collect()}
    assert got[1] == "PHONE_1\nPHONE_1 EMAIL_1"
    assert ax.anonymize_text(df, "text", "relaxed", as_of, safe, ["d"]).where("text like '777%'").count() == 0
