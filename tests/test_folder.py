import os

from pyspark.sql import functions as F

from hushframe.functions.text import line_count, lines_of, word_count
from hushframe.plans import folder
from hushframe.plans.memo import ResultStore
from hushframe.sources import catalog
from hushframe.sources.documents import read_documents, read_text_lines


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def name(row):
    return row["dataset"].rsplit("/", 1)[1]


def damaged(root):
    write(root / "a.csv", "id,note\n1,x\n2,y,novak@example.com\n")
    write(root / "b.csv", b"id,jm\xe9no\n1,Alena\n")
    write(root / "c.csv", "id,note\n")
    write(root / "empty one.csv", "")
    write(root / "e+1.txt", "")
    write(root / "good.csv", 'id,mail\n1,"eva@example.com"\n2,"two\nlines"\n')
    write(root / "notes.txt", "first\n\nwrite to jan@example.com or jan@example.com\n")


def test_no_damaged_file_is_called_clean(spark, tmp_path, as_of):
    damaged(tmp_path)
    made = folder.explore_folder(spark, str(tmp_path), "strict", as_of)
    assert {r["name"] for r in made.files.collect()} == {"a.csv", "b.csv", "c.csv", "empty one.csv", "e+1.txt", "good.csv", "notes.txt"}
    flags = {}
    for r in made.events.where("event = 'pii_detection'").collect():
        flags.setdefault(name(r), set()).add((r["detail"], r["subject"], r["amount"]))
    assert flags["a.csv"] == {("has_pii=true", "EMAIL", 1)}
    assert flags["b.csv"] == {("has_pii=unknown", None, 0)}
    assert flags["c.csv"] == flags["empty one.csv"] == flags["e+1.txt"] == {("has_pii=false", None, 0)}
    assert ("has_pii=true", "EMAIL", 1) in flags["good.csv"] and flags["notes.txt"] == {("has_pii=true", "EMAIL", 2)}
    sizes = {name(r): (r["row_count"], r["column_count"], r["char_count"], r["word_count"]) for r in made.profile.collect()}
    assert sizes == {
        "a.csv": (2, 2, None, None), "b.csv": (1, 2, None, None), "c.csv": (0, 2, None, None), "empty one.csv": (0, 0, None, None),
        "e+1.txt": (None, None, 0, 0), "good.csv": (2, 2, None, None), "notes.txt": (None, None, 51, 10),
    }
    found = {(name(r), r["place"], r["column"], r["pii_type"]) for r in made.findings.where("pii_type = 'EMAIL'").collect()}
    assert found == {("a.csv", 1, "(record)", "EMAIL"), ("good.csv", 0, "mail", "EMAIL"), ("notes.txt", 3, "text", "EMAIL")}
    listed = {(name(r), r["subject"], r["amount"]) for r in made.events.where("event = 'records_quarantined'").collect()}
    assert listed == {("a.csv", "surplus_fields", 1), ("b.csv", "undecodable", 1)}
    assert all("novak" not in (r["record"] or "") for r in folder.masked_quarantine(made).collect())
    safe = spark.createDataFrame([(str(tmp_path / "good.csv"), "Strict", 0, "mail", "EMAIL", "email_pattern")], "dataset string, mode string, place long, column string, pii_type string, rule string")
    rules = {r["rule"] for r in made.findings.where("column = 'mail'").collect()}
    marked = folder.explore_folder(spark, str(tmp_path), "strict", as_of, safe=safe.withColumn("rule", F.lit(min(rules))))
    assert marked.effective.count() == made.findings.count() - 1 and marked.findings.count() == made.findings.count()


def test_only_new_and_changed_files_are_read_again(spark, tmp_path, as_of):
    root, store = tmp_path / "data", str(tmp_path / "store")
    damaged(root)

    def explore(mode="strict", **options):
        return folder.explore_folder(spark, str(root), mode, as_of, store, **options)

    def all_of(made):
        return tuple(sorted(map(repr, df.collect())) for df in (made.profile, made.findings, made.quarantine, made.events))

    def read(made):
        return {r["name"] for r in made.read.collect()}

    first = explore()
    assert len(read(first)) == 7
    plain = folder.explore_folder(spark, str(root), "strict", as_of)
    assert all_of(first) == all_of(plain)
    again = explore()
    assert read(again) == set() and all_of(again) == all_of(first)
    # Same size and time, other content: what comes back is the stored result.
    before = (root / "notes.txt").stat()
    write(root / "notes.txt", (root / "notes.txt").read_text().replace("@", "#"))
    os.utime(root / "notes.txt", ns=(before.st_atime_ns, before.st_mtime_ns))
    assert all_of(explore()) == all_of(first)
    write(root / "good.csv", "id,mail\n1,nobody\n")
    write(root / "new.txt", "call eva@example.com\n")
    (root / "a.csv").unlink()
    third = explore()
    assert read(third) == {"good.csv", "new.txt"}
    assert {name(r) for r in third.findings.where("pii_type = 'EMAIL'").collect()} == {"notes.txt", "new.txt"}
    assert {name(r) for r in third.profile.collect()} == {"b.csv", "c.csv", "empty one.csv", "e+1.txt", "good.csv", "notes.txt", "new.txt"}
    # Another mode has results of its own; a run without its list of files does not count.
    assert len(read(explore("balanced"))) == 7
    kept = ResultStore(spark, store, {"profile": folder.SIZE, "findings": folder.PLACE, "quarantine": folder.QUARANTINE}, f"strict/{as_of}")
    results = {"profile": third.profile, "findings": third.findings, "quarantine": third.quarantine}
    broken = ResultStore(spark, str(tmp_path / "other"), kept.schemas, f"strict/{as_of}")
    results["profile"].write.parquet(f"{broken.folder}/profile/run=x")
    assert broken.unknown(third.files).count() == 7 and broken.of(third.files, "profile").count() == 0
    kept.compact(third.files)
    assert read(explore()) == set() and all_of(explore()) == all_of(third)


def test_anonymized_folder(spark, tmp_path, as_of):
    root = tmp_path / "data"
    damaged(root)
    write(root / "good2.csv", "id,mail\n7,eva@example.com\n8,other@example.com\n")
    made = folder.anonymize_folder(spark, str(root), "strict", as_of)
    tables = {header: a.table for header, a in made.tables}
    rows = {(r["_source"].rsplit("/", 1)[1], r["_row_idx"]): r["mail"] for r in tables["id,mail"].collect()}
    assert rows == {("good.csv", 0): "EMAIL_1", ("good.csv", 1): "two\nlines", ("good2.csv", 0): "EMAIL_1", ("good2.csv", 1): "EMAIL_2"}
    assert [(r["id"], r["note"]) for r in tables["id,note"].collect()] == [("1", "x")]
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in made.texts.collect()}
    assert "jan@" not in texts["notes.txt"] and texts["notes.txt"].count("EMAIL_1") == 2
    paths = made.export(str(tmp_path / "out"))
    assert len(paths) == len(made.tables) + 1 and all("@example" not in line for p in paths[:-1] for line in spark.read.text(p).toPandas()["value"])


def test_lines_of_large_files_are_those_of_whole_texts(spark, tmp_path):
    contents = [b"a\r\nb\rc\n\xff\xfed\n", b"no end", b"x\x0b", b"x\x0b\n\ny", "\ufeffmark\nž w\r".encode(), b"\n\n\n", b"\r\n" * 40]
    contents.append("".join(f"line {k} of many, {'word ' * (k % 9)}\n" + "\x0c" * (k % 50 == 0) for k in range(400)).encode())
    contents.append("".join(f"plain {k}\n" for k in range(300)).encode())
    for k, data in enumerate(contents):
        write(tmp_path / f"{k}.txt", data)
    write(tmp_path / "none.txt", b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines, counts = read_text_lines(spark, str(tmp_path))
        pieces = lines.select("path", "line_no", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
        got = {(r["path"].rsplit("/", 1)[1], r["line_no"] + r["at"]): r["line"] for r in pieces.collect() if r["line"]}
        sizes = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in counts.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = read_documents(spark, str(tmp_path))
    want = {(r["path"].rsplit("/", 1)[1], r["at"] + 1): r["line"] for r in whole.select("path", F.posexplode(lines_of(F.col("text"))).alias("at", "line")).collect()}
    assert got == {k: v.removeprefix("﻿") for k, v in want.items() if v}
    text = F.col("text")
    expected = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in whole.select("path", F.length("text"), line_count(text), word_count(F.lower("text"))).collect()}
    assert sizes == {k: v for k, v in expected.items() if k != "none.txt"}


def test_empty_files_are_listed(spark, tmp_path):
    for n in ("a b+c%20.csv", "sub/x.txt", "y.pdf", "_hidden.csv"):
        write(tmp_path / n, "")
    write(tmp_path / "full.md", "x")
    names = lambda **o: sorted((r["name"], r["size_bytes"]) for r in catalog.file_catalog(spark, str(tmp_path), **o).collect())
    assert names() == [("a b+c%20.csv", 0), ("full.md", 1), ("x.txt", 0)]
    assert names(size_range=(1, None)) == [("full.md", 1)] and names(recursive=False) == [("a b+c%20.csv", 0), ("full.md", 1)]
    only = tmp_path / "only"
    write(only / "z.csv", "")
    assert [r["name"] for r in catalog.file_catalog(spark, str(only)).collect()] == ["z.csv"]
