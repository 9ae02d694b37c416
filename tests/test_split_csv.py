import csv
import io
import random

import numpy as np
import pytest

from hushframe.sources import delimited, split_csv
from hushframe.sources.split_csv import csv_records, read_split_tables, states_before


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_chained_effects_are_those_of_one_step_after_the_other():
    draw = random.Random(1)
    for _ in range(200):
        n = draw.randint(0, 30)
        outside, inside = (np.array([draw.random() < 0.5 for _ in range(n)], bool) for _ in range(2))
        for state in (False, True):
            before, now = [], state
            for o, i in zip(outside, inside, strict=True):
                before.append(now)
                now = bool(i if now else o)
            got, end = states_before(outside, inside, state)
            assert got.tolist() == before and end == now


def messy(draw, rows, sep=","):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator=draw.choice(["\n", "\r\n"]), quoting=draw.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    pieces = ["a", 'x"y', "p,q;r", "two\nlines", '"', '""', "\n\n", " ", "", "ž|", '",\n"', "7" * draw.randint(1, 150), "\n" * draw.randint(1, 400)]
    table = [["id", "v", "w"]] + [[str(k), draw.choice(pieces), "".join(draw.choices(pieces, k=3))] for k in range(rows)]
    writer.writerows(table)
    return out.getvalue(), table


def test_rows_are_those_of_the_one_task_reader(spark, tmp_path, small_splits):
    draw = random.Random(7)
    tables = {}
    for k in range(4):
        text, table = messy(draw, 50 if k else 0)
        write(tmp_path / f"{k}.csv", text.rstrip("\r\n") if k == 3 else text)
        tables[str(tmp_path / f"{k}.csv")] = table
    assert split_csv.scan_lines(spark, [*tables]).select("path", "start").distinct().count() > 20
    made = read_split_tables(spark, [*tables], na_values=False)
    assert sorted(p for t in made for p in t.paths) == sorted(tables)
    for t in made:
        assert t.quarantine.collect() == []
        rows = t.rows.orderBy("_path", "_row_idx").collect()
        for path in t.paths:
            got = [r for r in rows if r["_path"] == path]
            assert [r["_row_idx"] for r in got] == list(range(len(tables[path]) - 1))
            assert [[r["id"], r["v"] or "", r["w"] or ""] for r in got] == tables[path][1:]
            whole = delimited.read_text_table(spark, path, na_values=False).collect()
            assert [tuple(x or "" for x in r) for r in whole] == [tuple(x or "" for x in r[2:]) for r in got]


def test_quotes_inside_plain_fields_open_nothing(spark, tmp_path, small_splits):
    lines = [f'{k},5" disk,"in ""quotes"", and\nmore",' + "z" * (k % 40) for k in range(60)]
    write(tmp_path / "t.csv", "a,b,c,d\n" + "\n".join(lines) + "\n")
    (made,) = read_split_tables(spark, [str(tmp_path / "t.csv")])
    rows = made.rows.orderBy("_row_idx").collect()
    assert len(rows) == 60 and {r["b"] for r in rows} == {'5" disk'} and {r["c"] for r in rows} == {'in "quotes", and\nmore'}


def test_no_record_that_does_not_fit_goes_unseen(spark, tmp_path):
    write(tmp_path / "a.csv", b"id,note\n1,x\n\n2,y,novak@example.com\n3\n4,\xe9\n5,\"p\nq\",r,s\n")
    write(tmp_path / "b.csv", b"jm\xe9no,b\n1,2\n")
    write(tmp_path / "c.csv", b'id,note\n1,"never\nclosed, 2\n3,4\n')
    write(tmp_path / "d.csv", b"\n\n")
    write(tmp_path / "e.csv", b"")
    write(tmp_path / "f.csv", "﻿id,note\n1,ok\n".encode())
    write(tmp_path / "g.csv", b"only,header\n")
    paths = [str(tmp_path / f"{k}.csv") for k in "abcdefg"]
    made = {t.header: t for t in read_split_tables(spark, paths)}
    assert set(made) == {"id,note", "jm�no,b", "only,header"}
    listed = {(r["path"][-5], r["row_idx"], tuple(r["reasons"]), r["record"]) for t in made.values() for r in t.quarantine.collect()}
    assert listed == {
        ("a", 1, ("surplus_fields",), "2,y,novak@example.com"), ("a", 2, ("missing_fields",), "3"), ("a", 3, ("undecodable",), "4,�"),
        ("a", 4, ("surplus_fields",), '5,"p\nq",r,s'), ("b", -1, ("undecodable",), "jm�no,b"), ("c", 0, ("surplus_fields", "unclosed_quote"), '1,"never\nclosed, 2\n3,4'),
    }
    rows = {(r["_path"][-5], r["_row_idx"], r["id"], r["note"]) for r in made["id,note"].rows.collect()}
    assert rows >= {("a", 0, "1", "x"), ("a", 1, "2", "y"), ("a", 2, "3", None), ("f", 0, "1", "ok")}
    assert made["only,header"].rows.count() == 0 and made["only,header"].paths == [paths[6]]


def test_other_delimiters_and_odd_headers(spark, tmp_path):
    write(tmp_path / "semi.csv", 'x;y\n1;"2,5\n6"\n3;4,5\n')
    write(tmp_path / "one.csv", "x;y\n1;2\n")
    write(tmp_path / "odd.csv", "a,A,,a b\n1,2,3,4\n")
    tables = {t.header: t for t in read_split_tables(spark, [str(tmp_path / f"{n}.csv") for n in ("semi", "one", "odd")])}
    assert {(t.delimiter, h, tuple(t.rows.columns[2:])) for h, t in tables.items()} == {(";", "x;y", ("x", "y")), (",", "x;y", ("x;y",)), (",", "a,A,,a b", ("a0", "A1", "_c2", "a b"))} or len(tables) == 2
    assert [tuple(r)[2:] for r in tables["a,A,,a b"].rows.collect()] == [("1", "2", "3", "4")]
    semi = [t for t in read_split_tables(spark, [str(tmp_path / "semi.csv")])]
    assert [(t.delimiter, [tuple(r)[1:] for r in t.rows.orderBy("_row_idx").collect()]) for t in semi] == [(";", [(0, "1", "2,5\n6"), (1, "3", "4,5")])]
    assert read_split_tables(spark, []) == []
    assert csv_records(spark, str(tmp_path / "one.csv")).count() == 2


def test_small_splits_share_tasks(spark, tmp_path):
    rows = [f'{i},"a{i}\n,{i % 7}"' if i % 3 else f"{i},b{i}" for i in range(20_000)]
    (tmp_path / "one.csv").write_text("\n".join(["key,value", *rows]) + "\n")
    before = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for name, value in zip(before, ("2k", "1k"), strict=True):
            spark.conf.set(name, value)
        lines = split_csv.scan_lines(spark, [str(tmp_path / "one.csv")])
        assert lines.select("start").distinct().count() > 100
        assert lines.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        records = split_csv.csv_records(spark, [str(tmp_path / "one.csv")])
        assert records.filter("closed and record_no > 0").orderBy("record_no").select("record").rdd.map(lambda r: r[0]).collect() == rows
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_the_quarantine_parses_a_record_once(spark, tmp_path):
    write(tmp_path / "a.csv", 'a,b\n1,2\n3\n4,5,6\n"x\ny",7\n8,"open\n')
    (table,) = read_split_tables(spark, [str(tmp_path / "a.csv")])
    assert table.quarantine._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 1
    assert sorted((r["row_idx"], r["reasons"]) for r in table.quarantine.collect()) == [
        (1, ["missing_fields"]), (2, ["surplus_fields"]), (4, ["unclosed_quote"]),
    ]
