import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushframe.operators import profile_table as pt
from hushframe.operators.ordered import numbered, running_total, sorted_once


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, float("nan"), 0.0, rng.gauss(0, 9)]), rng.randint(0, 3) if i % 3 else 2, rng.random() < 0.5, None)
            for i in range(3001)]
    return pd.DataFrame(rows, columns=["a", "b", "c", "d", "e"]), spark.createDataFrame(
        rows, "a bigint, b double, c int, d boolean, e double"
    ).repartition(6)


@pytest.mark.parametrize("direct_values", [0, 10**6])
def test_numeric_stats(numbers, direct_values):
    frame, df = numbers
    got = {r["column"]: (r["min"], r["max"], r["mean"], r["median"]) for r in pt.numeric_stats(df, direct_values).collect()}
    assert list(got) == ["a", "b", "c", "e"]
    for c in ("a", "b", "c"):
        s = pd.to_numeric(frame[c]).dropna()
        assert got[c] == pytest.approx((s.min(), s.max(), s.mean(), s.median()), rel=1e-12)
        assert got[c][3] == s.median()
    assert got["e"] == (None, None, None, None)


@pytest.mark.parametrize("buckets", [2, 7, 2048])
def test_selection_from_uneven_columns(spark, monkeypatch, buckets):
    monkeypatch.setattr(pt, "BUCKETS", buckets)
    inf = float("inf")
    columns = [
        [1e308, -1e308, 5.0, 5.0, 1e-320, 0.0], [inf, inf, -inf, 1.0, 2.0, 3.0], [inf] * 3 + [None] * 3, [2.0**-1074 * k for k in range(6)],
        [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0, 1.0, 1e300], [-1e300] * 2 + [3.0] * 4, [1e308, 1.5e308, 1.7e308, 1e308, 1.6e308, 1.6e308],
    ]
    df = spark.createDataFrame(list(zip(*columns, strict=True)), ", ".join(f"c{k} double" for k in range(len(columns)))).repartition(3)
    got = [r["median"] for r in pt.numeric_stats(df, 0).collect()]
    ordered = [sorted(v for v in c if v is not None) for c in columns]
    assert got == [pt._between(c[(len(c) - 1) // 2], c[len(c) // 2]) for c in ordered]
    assert "Sort" not in df.select(pt._bucket(F.col("c0"), 0.0, 1.0))._jdf.queryExecution().executedPlan().toString()


def test_missing_and_schema(numbers):
    frame, df = numbers
    got = {r["column"]: r["missing"] for r in pt.missing(df).collect()}
    assert got == frame.isna().sum().to_dict()
    assert [(r["column"], r["dtype"]) for r in pt.schema_listing(df).collect()] == [
        ("a", "int64"), ("b", "float64"), ("c", "int32"), ("d", "bool"), ("e", "float64"),
    ]
    assert pt.counts(df).collect()[0].asDict() == {"row_count": 3001, "column_count": 5}


def test_nested_columns_count_nulls_only(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "k int, v array<double>")
    assert {r["column"]: r["missing"] for r in pt.missing(df).collect()} == {"k": 0, "v": 1}
    assert pt.top_values(df).count() == 0


def test_top_values(spark):
    words = ["x"] * 5 + ["y"] * 5 + ["b", "a", "c", "d"] + [None] * 3
    df = spark.createDataFrame([(w, i, i % 2 == 0) for i, w in enumerate(words)], "w string, n int, f boolean")
    got = [(r["value"], r["count"]) for r in pt.top_values(df).orderBy("rank").collect()]
    assert got == [("x", 5), ("y", 5), ("nan", 3), ("a", 1), ("b", 1)]


def test_top_values_of_long_texts(spark):
    long_ = ["p" * 64 + tail for tail in "abc"]
    df = spark.createDataFrame([(t, 1) for t in [*long_, long_[1], "short", "short", "z" * 64]], "t string, n int")
    got = [(r["value"], r["count"]) for r in pt.top_values(df, 3).orderBy("rank").collect()]
    assert got == [(long_[1], 2), ("short", 2), (long_[0], 1)]
    # Many long values that differ behind their first characters only: whole values decide, at the cut as well.
    ties = ["q" * 70 + f"{k:03d}" for k in range(200)]
    df = spark.createDataFrame([(t,) for t in reversed(ties)], "t string").repartition(5)
    got = [(r["value"], r["count"], r["rank"]) for r in pt.top_values(df, 4).orderBy("rank").collect()]
    assert got == [(t, 1, k + 1) for k, t in enumerate(ties[:4])]


@pytest.mark.parametrize("by_digest", [False, True])
def test_duplicates(spark, by_digest):
    rows = [(1, None, "a"), (1, None, "a"), (None, 1, "a"), (1, 1, None), (1, 1, ""), (1, 1, None), (1, None, "a")]
    df = spark.createDataFrame(rows, "a int, b int, c string")
    assert pt.duplicate_rows(df, by_digest).first()[0] == 3
    assert pt.duplicate_rows(df.limit(0), by_digest).first()[0] == 0


def test_numbers_across_tasks(spark):
    rng = random.Random(1)
    rows = [("h" if rng.random() < 0.5 else rng.choice("abc"), i, rng.randint(0, 5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(7)
    flat = sorted_once(df, ["g"], ["i"], "test")
    got = sorted((r["g"], r["i"], r["no"]) for r in numbered(flat, ["g"], "no").collect())
    want, seen, total = [], {}, {}
    sums = []
    for g, i, n in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want.append((g, i, seen[g]))
        sums.append((g, i, total.get(g, 0)))
        total[g] = total.get(g, 0) + n
    assert got == want
    got = sorted((r["g"], r["i"], r["before"]) for r in running_total(df, ["g"], ["i"], "n", "before").collect())
    assert got == sums
    assert flat.select(F.shiftright("_position", 33)).distinct().count() > 1
