"""A whole folder: list it, load each file in its own form, profile it, find personal data, leave a trail."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.masking import mask_value
from hushframe.modes import PrivacyMode, parse_mode
from hushframe.operators import audit, report
from hushframe.operators.anonymize_table import AnonymizedTable, anonymize_table
from hushframe.operators.anonymize_text import anonymize_text
from hushframe.operators.detect import detect_cells, detect_text, findings_of_cells
from hushframe.plans.memo import ResultStore
from hushframe.sources.catalog import file_catalog, kind_of
from hushframe.sources.documents import read_documents, read_text_lines
from hushframe.sources.export import export_table
from hushframe.sources.split_csv import PATH, ROW_INDEX, SplitTable, read_split_tables
from hushframe.storage import written

RECORD = "(record)"
#: A table of a folder, its source file and row number kept beside its columns.
SOURCE = "_source"
PLACE = "dataset string, kind string, place bigint, column string, pii_type string, rule string, confidence double, masked_preview string, raw_value string"
SIZE = "dataset string, kind string, row_count bigint, column_count bigint, char_count bigint, word_count bigint"
QUARANTINE = "dataset string, place bigint, reasons array<string>, record string"


@dataclass
class FolderExploration:
    """`files` is the catalog with the kind of each file; a dataset is a file, by its path.

    `profile` has one row per file: rows and columns of tables, characters and words of texts; files without content
    count 0. `findings` has the row number of a table or the line number of a text as `place`; those of a record that
    does not fit its table have the column `(record)`. `effective` leaves out the findings marked as safe. `raw_value` is
    restricted, and so is `quarantine`, the records that do not fit: place, reasons and the whole record. `events` is the
    audit trail: files with quarantined records and no finding are `has_pii=unknown`, never clean. `read` are the files
    that were read for this; the results of all others come from the store.
    """

    files: DataFrame
    profile: DataFrame
    findings: DataFrame
    effective: DataFrame
    quarantine: DataFrame
    events: DataFrame
    read: DataFrame


def _sized(df: DataFrame, kind: str, **counts: Column) -> DataFrame:
    none = F.lit(None).cast("bigint")
    names = ("row_count", "column_count", "char_count", "word_count")
    return df.select("dataset", F.lit(kind).alias("kind"), *[counts.get(n, none).cast("bigint").alias(n) for n in names])


def _found(df: DataFrame, kind: str, place: Column) -> DataFrame:
    return df.select("dataset", F.lit(kind).alias("kind"), place.cast("bigint").alias("place"), "column", "pii_type", "rule", "confidence", "masked_preview", "raw_value")


def _explored_table(table: SplitTable, mode: PrivacyMode, as_of: date | str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes, findings and quarantine of the files of one header. Records that do not fit are searched as texts, too."""
    spark = table.rows.sparkSession
    cells = detect_cells(table.rows, [PATH, ROW_INDEX], mode, as_of, skip=[PATH, ROW_INDEX])
    found = _found(findings_of_cells(cells).withColumn("dataset", F.col(PATH)), "csv", F.col(ROW_INDEX))
    # Written here, since both the search of its records and the result read it.
    listed = written(table.quarantine.select(F.col("path").alias("dataset"), F.col("row_idx").alias("place"), "reasons", "record"), "folder-listed")
    hidden = detect_text(listed.select(F.col("dataset").alias("file"), "place", "record"), ["file", "place"], "record", mode, as_of)
    hidden = _found(hidden.withColumns({"dataset": F.col("file"), "column": F.lit(RECORD)}), "csv", F.col("place"))
    files = spark.createDataFrame([(p,) for p in table.paths], "dataset string")
    rows = table.rows.groupBy(F.col(PATH).alias("dataset")).agg(F.count(F.lit(1)).alias("rows"))
    width = len(table.rows.columns) - 2
    size = _sized(files.join(rows, "dataset", "left"), "csv", row_count=F.coalesce("rows", F.lit(0)), column_count=F.lit(width))
    return size, found.unionByName(hidden), listed


def _explored_texts(spark: SparkSession, paths: Sequence[str], mode: PrivacyMode, as_of: date | str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of text files, line by line, so that a large file is no single row."""
    lines, counts = read_text_lines(spark, paths)
    # A row of several lines has the number of its first one.
    found = detect_text(lines.withColumnRenamed("line_no", "first_line"), ["path", "first_line"], "text", mode, as_of)
    found = _found(found.withColumn("dataset", F.col("path")), "text", F.col("first_line") + F.col("line_no") - 1)
    size = _sized(counts.withColumnRenamed("path", "dataset"), "text", char_count=F.col("char_count"), word_count=F.col("word_count"))
    return size, found, spark.createDataFrame([], QUARANTINE)


def _union(spark: SparkSession, parts: Sequence[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))


def _explored(spark: SparkSession, files: DataFrame, mode: PrivacyMode, as_of: date | str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes, findings and quarantine of all given files; those without content have a size of 0."""
    by_kind = {r["kind"]: r["paths"] for r in files.groupBy("kind").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()}
    parts = [_explored_table(t, mode, as_of) for t in read_split_tables(spark, by_kind.get("csv", []))]
    if "text" in by_kind:
        parts.append(_explored_texts(spark, by_kind["text"], mode, as_of))
    sizes, found, listed = (_union(spark, [p[k] for p in parts], schema) for k, schema in enumerate((SIZE, PLACE, QUARANTINE)))
    sizes = written(sizes, "folder-sizes")
    empty = files.select(F.col("path").alias("dataset"), "kind").join(sizes, "dataset", "left_anti")
    table, zero = F.col("kind") == "csv", F.lit(0).cast("bigint")
    empty = empty.select(
        "dataset", "kind", *[F.when(table, zero).alias(n) for n in ("row_count", "column_count")],
        *[F.when(~table, zero).alias(n) for n in ("char_count", "word_count")],
    )
    return sizes.unionByName(empty), found, listed


def explore_folder(
    spark: SparkSession,
    root: str,
    mode: str | PrivacyMode,
    as_of: date | str | None = None,
    store: str | None = None,
    safe: DataFrame | None = None,
    **filters: object,
) -> FolderExploration:
    """Explore the supported files below `root`; `filters` are those of the catalog. An empty folder gives empty tables.

    With a `store` (a folder), results are kept there by path, size and time of the file, mode and `as_of`, and only files
    that it does not know so are read. Marks in `safe` (`dataset`, `mode`, `place`, `column`, `pii_type`, `rule`) change
    `effective` only. The paths of the files pass through the driver, as in every scan; their content does not.
    """
    mode = parse_mode(mode)
    files = written(file_catalog(spark, root, **filters).withColumn("kind", kind_of(F.col("name"))), "folder")
    if store is None:
        read = files
        profile, findings, quarantine = _explored(spark, files, mode, as_of)
        findings, quarantine = written(findings, "folder-findings"), written(quarantine, "folder-quarantine")
    else:
        known = ResultStore(spark, store, {"profile": SIZE, "findings": PLACE, "quarantine": QUARANTINE}, f"{mode.value}/{as_of or date.today()}")
        read = written(known.unknown(files), "folder-unknown")
        if not read.isEmpty():
            known.add(read, dict(zip(("profile", "findings", "quarantine"), _explored(spark, read, mode, as_of), strict=True)))
        profile, findings, quarantine = (known.of(files, name) for name in ("profile", "findings", "quarantine"))
    effective = findings if safe is None else report.effective_findings(findings, safe, ["place"], mode)
    seen = files.select(F.col("path").alias("dataset"))
    events = audit.file_loaded(files).unionByName(audit.detection_summary(findings, mode, seen, quarantine)).unionByName(audit.quarantined(quarantine, mode))
    return FolderExploration(files, profile, findings, effective, quarantine, events, read)


@dataclass
class FolderRelease:
    """Anonymized copies of the files of a folder.

    `tables` has one table for each header in use; `_source` and `_row_idx` name the file and the row. Records in the
    quarantine are no part of it: they have no columns that could be anonymized. `texts` has `path` and `text`.
    """

    tables: list[tuple[str, AnonymizedTable]]
    texts: DataFrame | None

    def export(self, folder: str) -> list[str]:
        """One CSV export for each header, with the source of each row, and one Parquet export of the texts."""
        paths = [export_table(a.table, folder, f"{number}.csv") for number, (_, a) in enumerate(self.tables)]
        if self.texts is not None:
            self.texts.write.parquet(f"{folder.rstrip('/')}/texts")
            paths.append(f"{folder.rstrip('/')}/texts")
        return paths


def anonymize_folder(spark: SparkSession, root: str, mode: str | PrivacyMode, as_of: date | str | None = None, safe: DataFrame | None = None, **filters: object) -> FolderRelease:
    """Anonymize the supported files below `root`.

    Files with the same header are one table: a value has one token in all of them, numbered by path and row. Rows whose
    record is in the quarantine stay out, as what does not fit a column is not covered by its tokens. Each text has tokens
    of its own. `safe` has `_path`, `_row_idx` and what marks of tables have, for the dataset `folder`.
    """
    files = file_catalog(spark, root, **filters).withColumn("kind", kind_of(F.col("name")))
    by_kind = {r["kind"]: r["paths"] for r in files.groupBy("kind").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()}
    tables = []
    for table in read_split_tables(spark, by_kind.get("csv", [])):
        fits = table.rows.join(table.quarantine.select(F.col("path").alias(PATH), F.col("row_idx").alias(ROW_INDEX)), [PATH, ROW_INDEX], "left_anti")
        made = anonymize_table(fits, [PATH, ROW_INDEX], mode, as_of, safe, dataset="folder", skip=[PATH, ROW_INDEX])
        tables.append((table.header, AnonymizedTable(made.table.withColumnRenamed(PATH, SOURCE), made.dictionary)))
    texts = None
    if "text" in by_kind:
        texts = anonymize_text(read_documents(spark, by_kind["text"]), "text", mode, as_of)
    return FolderRelease(tables, texts)


def masked_quarantine(exploration: FolderExploration) -> DataFrame:
    """The quarantine for eyes that may not see its records: their text masked as a whole."""
    return exploration.quarantine.withColumn("record", mask_value(F.col("record"), F.lit("RECORD")))
