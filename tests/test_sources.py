import os

from pyspark.sql import functions as F

from hushframe.operators.profile_table import missing
from hushframe.sources import catalog, delimited, documents, export


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_catalog(spark, tmp_path):
    for i, (name, size) in enumerate([("a.CSV", 10), ("b.txt", 2048), ("sub/Notes.md", 5), ("c.pdf", 7), ("noext", 3)]):
        write(tmp_path / name, "x" * size)
        os.utime(tmp_path / name, (1_700_000_000 + i * 86400,) * 2)

    def names(**options):
        return [r["name"] for r in catalog.file_catalog(spark, str(tmp_path), **options).collect()]

    assert names() == ["Notes.md", "b.txt", "a.CSV"]
    assert names(recursive=False) == ["b.txt", "a.CSV"]
    assert names(search=" NOTES ") == ["Notes.md"]
    assert names(file_types=[".TXT", ".pdf"]) == ["b.txt"] and names(file_types=[]) == names()
    assert names(size_range=(10, 2048)) == ["b.txt", "a.CSV"] and names(size_range=(None, 9)) == ["Notes.md"]
    assert names(modified_range=("2023-11-15", "2023-11-16")) == ["b.txt"]
    row = catalog.file_catalog(spark, str(tmp_path), search="a.csv").first()
    assert (row["path"], row["extension"], row["size_bytes"]) == (str(tmp_path / "a.CSV"), ".csv", 10)
    assert catalog.file_catalog(spark, " ").count() == 0
    assert catalog.file_catalog(spark, str(tmp_path / "nothing")).count() == 0
    plan = catalog.file_catalog(spark, str(tmp_path), size_range=(1, 5))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "PushedFilters: [GreaterThanOrEqual(length,1)" in plan.replace("IsNotNull(length), ", "")


def test_kinds(spark):
    df = spark.createDataFrame([("a.b.CSV",), ("x.md",), (".csv",), ("plain",)], "n string")
    got = [tuple(r) for r in df.select(catalog.extension_of(F.col("n")), catalog.kind_of(F.col("n"))).collect()]
    assert got == [(".csv", "csv"), (".md", "text"), ("", "text"), ("", "text")]


def test_csv_types_and_quotes(spark, tmp_path):
    write(tmp_path / "t.csv", 'id,code,x,flag,q,n\n1,007,1.5,True,"x ""y"", z\nw",NA\n2,abc,,False,null,3\n3,,nan,TRUE,,4\n')
    raw = delimited.read_text_table(spark, str(tmp_path / "t.csv"))
    assert [r["code"] for r in raw.collect()] == ["007", "abc", None]
    assert delimited.infer_types(raw) == {"id": "bigint", "code": "string", "x": "double", "flag": "boolean", "q": "string", "n": "bigint"}
    typed = delimited.typed(raw)
    assert [tuple(r) for r in typed.collect()] == [
        (1, "007", 1.5, True, 'x "y", z\nw', None), (2, "abc", None, False, None, 3), (3, None, None, True, None, 4),
    ]
    assert {r["column"]: r["missing"] for r in missing(typed).collect()} == {"id": 0, "code": 1, "x": 2, "flag": 0, "q": 2, "n": 1}


def test_delimiters(spark, tmp_path):
    for name, d in (("a", ","), ("b", ";"), ("c", "\t"), ("d", "|")):
        write(tmp_path / f"{name}.csv", f"x{d}y\n" + "".join(f'{i}{d}"{name},;|"\n' for i in range(30)))
    write(tmp_path / "e.csv", "x\n1\n")
    got = {r["path"].rsplit("/", 1)[1]: r["delimiter"] for r in delimited.sniff_delimiters(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": ",", "b.csv": ";", "c.csv": "\t", "d.csv": "|", "e.csv": ","}
    files = [str(tmp_path / f"{n}.csv") for n in "abcd"]
    tables = delimited.read_by_delimiter(spark, files, always=True)
    assert {d: (t.columns, t.count()) for d, t in tables.items()} == {d: (["x", "y"], 30) for d in ",;\t|"}


def test_other_delimiters_are_a_fallback(spark, tmp_path):
    write(tmp_path / "one.csv", "x;y\n1;2\n")
    write(tmp_path / "bad.csv", "x;y\n1;2,5\n3;4,5\n")
    write(tmp_path / "good.csv", 'x,y\n1,"2,5"\n')
    tables = delimited.read_by_delimiter(spark, [str(tmp_path / f"{n}.csv") for n in ("one", "bad", "good")])
    assert sorted(tables) == [",", ";"]
    assert tables[";"].columns == ["x", "y"] and [tuple(r) for r in tables[";"].collect()] == [("1", "2,5"), ("3", "4,5")]
    assert [r["path"].rsplit("/", 1)[1] for r in delimited.failing_files(spark, str(tmp_path)).collect()] == ["bad.csv"]


def test_line_ends_inside_quotes_are_no_surplus(spark, tmp_path):
    write(tmp_path / "t.csv", 'id,note;alt\n1,"p;q\nr,s,t;u"\n2,v;w\n')
    tables = delimited.read_by_delimiter(spark, [str(tmp_path / "t.csv")])
    assert {d: t.columns for d, t in tables.items()} == {",": ["id", "note;alt"]}
    assert [tuple(r) for r in tables[","].collect()] == [("1", "p;q\nr,s,t;u"), ("2", "v;w")]


def test_files_with_other_headers_keep_their_columns(spark, tmp_path):
    write(tmp_path / "a.csv", "id,name\n1,A\n")
    write(tmp_path / "b.csv", "mail,id,phone\nx@y.cz,7,602\n")
    files = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert {k: t.columns for k, t in delimited.read_tables(spark, files).items()} == {
        (",", "id,name"): ["id", "name"], (",", "mail,id,phone"): ["mail", "id", "phone"],
    }
    rows = delimited.read_by_delimiter(spark, files)[","].select("id", "name", "mail", "phone").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "A", None, None), ("7", None, "x@y.cz", "602")]


def test_surplus_fields_are_reported(spark, tmp_path):
    write(tmp_path / "t.csv", "id,name\n1,A\n2,B,EXTRA\n")
    assert [r["record"] for r in delimited.surplus_records(spark, str(tmp_path / "t.csv")).collect()] == ["2,B,EXTRA"]


def test_row_index(spark, tmp_path):
    lines = [f"{i},{'v' * (i % 50)}" for i in range(5000)]
    write(tmp_path / "t.csv", "i,v\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = delimited.with_row_index(delimited.read_text_table(spark, str(tmp_path / "t.csv"), multiline=False))
        assert df.where("row_idx <> cast(i as bigint)").count() == 0 and df.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_documents(spark, tmp_path):
    write(tmp_path / "a.txt", b"x\xffy\r\nz")
    write(tmp_path / "sub/b.md", "žluť")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "xy\nz", "b.md": "žluť"}
    df = spark.createDataFrame([(1, "ab" * 4000)], "d int, t string")
    assert len(documents.preview_text(df, ["d"], "t").first()["preview"]) == 5000


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "q", \n'), (2, None)], "k int, v string")
    path = export.export_table(df, str(tmp_path), "/data/people.csv")
    assert path.endswith("/people_anonymized.csv")
    back = delimited.read_text_table(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == [("1", ' a "q", \n'), ("2", None)]
    assert delimited.preview_rows(df, ["k"], 1).collect()[0]["k"] == 1
