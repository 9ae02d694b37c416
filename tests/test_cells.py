import pytest
from pyspark.sql import functions as F

from hushframe.modes import ContextScope, PrivacyMode, parse_mode, parse_scope
from hushframe.operators import report
from hushframe.operators.detect import detect_table
from hushframe.operators.rules import column_flags

ALL = ("strict", "balanced", "relaxed")

# (column, cell, modes, rules found)
CASES = [
    ("x", "jan.novak@example.com", ALL, ["regex_email"]),
    ("x", "write to a@b.cz now", ALL, ["regex_email"]),
    ("x", "a@b", ALL, []),
    ("x", "+420 777 888 999", ("relaxed",), ["regex_phone"]),
    ("x", "777 888 999", ("relaxed",), ["regex_phone"]),
    ("x", "777888999", ("relaxed",), ["regex_phone"]),
    ("x", "77788899", ("relaxed",), []),
    # Too many digits in the whole cell, although a part of it is a number.
    ("x", "777 888 999 and 777 888 999", ("relaxed",), []),
    ("x", "1988-05-17", ("relaxed",), ["regex_date"]),
    ("x", "5.1.1988", ("relaxed",), ["regex_date"]),
    ("x", "05/01/1988", ("relaxed",), ["regex_date", "regex_bank"]),
    ("x", "on 1988-05-17", ("relaxed",), []),
    ("x", "31.02.1988", ("relaxed",), []),
    ("x", "1899-05-17", ("relaxed",), []),
    ("x", "2015-12-31", ("relaxed",), ["regex_date"]),
    ("x", "2016-01-01", ("relaxed",), []),
    ("x", "2027-01-01", ("relaxed",), []),
    ("Date of Birth", "2024-01-01", ("relaxed",), ["regex_date"]),
    ("date_of_birth", "2026-01-02", ("relaxed",), []),
    ("created_at", "1988-05-17", ("relaxed",), []),
    ("x", "850101/1234", ("relaxed",), ["regex_rc", "regex_bank"]),
    ("x", "850101/1234", ("strict", "balanced"), ["regex_bank"]),
    ("x", "850101/1230", ("relaxed",), ["regex_rc", "regex_bank"]),
    # 8501010012 is a multiple of 11.
    ("x", "8501010012", ("relaxed",), ["regex_phone", "regex_rc"]),
    ("x", "850101/0012", ("balanced",), ["regex_rc", "regex_bank"]),
    ("x", "850101/001", ("balanced",), ["regex_rc"]),
    ("x", "851301/001", ("balanced",), []),
    ("rodne_cislo", "850101/1234", ALL[:2], ["regex_bank", "column_rc_heuristic"]),
    ("rodne_cislo", "850101/0012", ("balanced",), ["regex_rc", "regex_bank"]),
    ("RČ", "nic", ALL, ["column_rc_heuristic"]),
    ("x", "19-2000145399/0800", ("relaxed",), ["regex_rc", "regex_bank"]),
    ("x", "19-2000145399/0800", ALL[:2], ["regex_bank"]),
    ("x", "CZ6508000000192000145399", ALL, ["regex_bank"]),
    ("x", "de89370400440532013000", ALL, ["regex_bank"]),
    ("Příjmení", "Novák", ALL, ["column_name_heuristic"]),
    ("město", "Praha", ALL, ["column_address_heuristic"]),
    ("city", "110 00", ALL, ["column_address_heuristic"]),
    ("x", "110 00", ALL[:2], ["postcode_heuristic"]),
    ("x", "110\u00a000", ALL[:2], ["postcode_heuristic"]),
    ("x", "777\u00a0888\u00a0999", ("relaxed",), ["regex_phone"]),
    ("x", "12345", ALL[:2], ["postcode_heuristic"]),
    ("x", "12345", ("relaxed",), []),
    ("x", "Dlouhá Třída", ("strict",), ["address_hint_heuristic"]),
    ("x", "Dlouhá Třída", ("balanced", "relaxed"), []),
    ("x", "ul. Dlouhá 110 00", ("strict",), ["postcode_heuristic"]),
    ("name", "a@b.cz", ALL, ["regex_email", "column_name_heuristic"]),
    ("name", "   ", ALL, []),
    ("name", None, ALL, []),
]


@pytest.mark.parametrize("mode", ALL)
def test_rules(spark, as_of, mode):
    cases = [(i, c, v, rules) for i, (c, v, modes, rules) in enumerate(CASES) if mode in modes]
    names = list(dict.fromkeys(c for _, c, _, _ in cases))
    rows = [(i, *[v if c == name else None for name in names]) for i, c, v, _ in cases]
    df = spark.createDataFrame(rows, ", ".join(["k int", *[f"`{n}` string" for n in names]]))
    found = {}
    for r in detect_table(df, ["k"], mode, as_of).where("column <> 'k'").orderBy("k", "rule_order").collect():
        found.setdefault(r["k"], []).append(r["rule"])
    wrong = [(c, v, found.get(i, []), want) for i, c, v, want in cases if found.get(i, []) != want]
    assert not wrong


@pytest.mark.parametrize("mode,confidence", [("strict", 0.72), ("balanced", 0.62), ("relaxed", 0.55)])
def test_column_confidence_by_mode(spark, as_of, mode, confidence):
    df = spark.createDataFrame([(1, "Jan", "Praha")], "k int, name string, city string")
    rows = detect_table(df, ["k"], mode, as_of).collect()
    assert [(r["pii_type"], r["confidence"]) for r in rows] == [("NAME", confidence), ("ADDRESS", confidence)]


def test_typed_columns(spark, as_of):
    df = spark.createDataFrame(
        [(1, 8501010012, 123456789.0, True, 0.0001), (2, None, float("nan"), None, 1e16)],
        "k int, n bigint, x double, name boolean, y double",
    )
    rows = detect_table(df, ["k"], "balanced", as_of).orderBy("k", "column_ord", "rule_order").collect()
    got = [(r["k"], r["column"], r["pii_type"], r["raw_value"]) for r in rows]
    assert got == [
        (1, "n", "PHONE", "8501010012"), (1, "n", "RC", "8501010012"), (1, "x", "PHONE", "123456789.0"),
        (1, "name", "NAME", "True"),
    ]


def test_dob_needs_hint_or_age_and_no_timestamp(spark, as_of):
    columns = ["created_at", "updated_at", "timestamp", "created", "modified", "event_date", "date_of_birth", "birth", "narozeni"]
    old, recent = "2006-01-01", "2024-01-01"
    rows = [(0, *[old] * 6, *[recent] * 3), (1, *[old] * 5, recent, *[recent] * 3)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} string" for c in columns))
    found = detect_table(df, ["k"], "strict", as_of).where("pii_type = 'DOB'").collect()
    assert len(found) == 7
    assert [r["k"] for r in found if r["column"] == "event_date"] == [0]
    assert not {r["column"] for r in found} & set(columns[:5])


def test_wide_table_is_one_stage(spark, as_of):
    wide = spark.range(3).select("id", *[F.concat(F.lit("u"), "id", F.lit(f"@c{i}.cz")).alias(f"c{i}") for i in range(300)])
    found = detect_table(wide, ["id"], "relaxed", as_of)
    assert found.count() == 900
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_rc_extended_months_is_an_option(spark, as_of):
    df = spark.createDataFrame([(1, "855101/0014"), (2, "855101/0019")], "k int, x string")
    assert detect_table(df, ["k"], "balanced", as_of).where("pii_type = 'RC'").count() == 0
    number = next(n for n in range(8551010000, 8551020000) if n % 11 == 0)
    df = spark.createDataFrame([(1, str(number))], "k int, x string")
    assert detect_table(df, ["k"], "balanced", as_of, rc_extended_months=True).where("pii_type = 'RC'").count() == 1


def test_reports(spark, as_of):
    df = spark.createDataFrame(
        [(1, "a@b.cz", "x@y.cz"), (2, "a@b.cz", None)], "k int, mail string, name string"
    )
    found = detect_table(df, ["k"], "strict", as_of, "d")
    assert {r["pii_type"]: r["total"] for r in report.totals_by_type(found).collect()} == {"EMAIL": 3, "NAME": 1}
    columns = {r["pii_type"]: r["columns"] for r in report.columns_by_type(found).collect()}
    assert columns == {"EMAIL": ["mail", "name"], "NAME": ["name"]}
    assert report.rows_by_type(found, ["k"]).count() == 3
    safe = spark.createDataFrame(
        [("d", "Strict", 1, "name", "NAME", "column_name_heuristic")],
        "dataset string, mode string, k int, column string, pii_type string, rule string",
    )
    assert report.effective_findings(found, safe, ["k"], "strict").count() == 3
    assert report.effective_findings(found, safe, ["k"], "balanced").count() == 4
    shown = report.masked_samples(found, ["column_ord", "k", "rule_order"], 2)
    assert shown.count() == 2 and "raw_value" not in shown.columns


def test_row_key_is_checked(spark):
    df = spark.createDataFrame([(1, "a")], "raw int, x string")
    with pytest.raises(ValueError):
        detect_table(df, ["raw"], "strict")
    with pytest.raises(ValueError):
        detect_table(df, ["missing"], "strict")


def test_modes_and_flags():
    assert parse_mode(" BALANCED ") is PrivacyMode.BALANCED
    assert parse_mode("anything") is PrivacyMode.STRICT and parse_mode(None) is PrivacyMode.STRICT
    assert parse_scope("schema") is ContextScope.SCHEMA
    with pytest.raises(ValueError):
        parse_scope("all")
    assert column_flags("Datum narození").birth and column_flags("user-DOB").birth
    assert not column_flags("birthplace").birth
    assert column_flags(" Celé Jméno ").name and column_flags("ZIP").address and column_flags("Created At").timestamp
