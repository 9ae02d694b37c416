"""Delimited text tables: reading as text, NA tokens, type inference, delimiter sniffing and row numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions.text import na_to_null
from hushframe.storage import few_splits

# Delimiters that a file may use.
DELIMITERS = (",", ";", "\t", "|")
HEAD_LINES = 20
MONO_ID = "_row_id"


def read_text_table(
    spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", na_values: bool = True, multiline: bool = True
) -> DataFrame:
    """Every column as text, for detection: leading zeros and number forms stay as they are written.

    A file with quoted line ends needs `multiline`, which reads each file in one task; files without any can be
    split by turning it off.
    """
    reader = spark.read.options(
        header="true", quote='"', escape='"', sep=delimiter, multiLine=str(multiline).lower(), mode="PERMISSIVE",
        inferSchema="false",
    )
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    if na_values:
        df = df.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def infer_types(df: DataFrame) -> dict[str, str]:
    """The narrowest of bigint, double, boolean and string that fits all present values of each text column."""
    tests = []
    for i, c in enumerate(df.columns):
        value = F.col(f"`{c}`")
        tests += [
            F.count(value).alias(f"n{i}"),
            F.count(_as_integer(value)).alias(f"i{i}"),
            F.count(_as_number(value)).alias(f"f{i}"),
            F.count(_as_boolean(value)).alias(f"b{i}"),
        ]
    row = df.agg(*tests).first()
    total = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            total[c] = "double"
        elif row[f"i{i}"] == n:
            total[c] = "bigint"
        elif row[f"f{i}"] == n:
            total[c] = "double"
        elif row[f"b{i}"] == n:
            total[c] = "boolean"
        else:
            total[c] = "string"
    return total


def _as_integer(value: Column) -> Column:
    return F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*$"), value.try_cast("bigint"))


def _as_number(value: Column) -> Column:
    form = r"(?i)^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity)\s*$"
    return F.when(value.rlike(form), value.try_cast("double"))


def _as_boolean(value: Column) -> Column:
    return F.when(value.isin("True", "TRUE", "true"), True).when(value.isin("False", "FALSE", "false"), False)


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """The table with inferred types, for profiling."""
    types = types or infer_types(df)
    casts = {"bigint": _as_integer, "double": _as_number, "boolean": _as_boolean, "string": lambda v: v}
    return df.select(*[casts[types[c]](F.col(f"`{c}`")).alias(c) for c in df.columns])


def _count_of(record: Column, delimiter: str) -> Column:
    """Delimiters outside quotes."""
    unquoted = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(delimiter), F.lit("")))


def records(spark: SparkSession, paths: str | Sequence[str], delimiter: str, multiline: bool = True) -> DataFrame:
    """The records of each file as the CSV parser sees them: `path`, `start`, `at`, `record`, `n` delimiters.

    The parser knows line ends inside quotes. A record with more than one field does not fit a table of one column and
    comes whole.
    """
    reader = spark.read.schema("only string, whole string").options(
        header="false", quote='"', escape='"', sep=delimiter, multiLine=str(multiline).lower(), mode="PERMISSIVE",
        columnNameOfCorruptRecord="whole",
    )
    return reader.csv(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.coalesce("whole", "only").alias("record"),
        # Spark wants a data column read besides the whole record, so the count of none is made from one.
        F.when(F.col("whole").isNull(), F.coalesce(F.length("only") * 0, F.lit(0)))
        .otherwise(_count_of(F.col("whole"), delimiter)).alias("n"),
    )


def sniff_delimiters(spark: SparkSession, paths: str | Sequence[str], multiline: bool = True) -> DataFrame:
    """Per file, the delimiter whose count is the same in the most head records; `path`, `delimiter`.

    Only the first records of a file take part: those of its first split, by their position in it.
    """
    head = Window.partitionBy("path").orderBy("at")
    counts = None
    for i, d in enumerate(DELIMITERS):
        # The first records of each file are kept before the shuffle, so no task sees a whole file.
        first = (
            records(spark, paths, d, multiline).where(F.col("start") == 0).select("path", "at", "n")
            .withColumn("line", F.row_number().over(head)).where(F.col("line") <= HEAD_LINES)
            .select("path", F.lit(i).alias("preference"), F.lit(d).alias("delimiter"), "n")
        )
        counts = first if counts is None else counts.unionByName(first)
    per_file = counts.groupBy("path", "preference", "delimiter").agg(
        F.mode("n", deterministic=True).alias("usual"), F.variance("n").alias("spread")
    )
    rank = Window.partitionBy("path").orderBy(
        F.desc(F.col("usual") > 0), F.coalesce("spread", F.lit(0.0)), F.desc("usual"), "preference"
    )
    return per_file.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") == 1).select("path", "delimiter")


def _headers(found: DataFrame) -> DataFrame:
    """Per file, its first record and the most delimiters of any; per split first, where a number orders the records."""
    per_split = found.groupBy("path", "start").agg(
        F.max("n").alias("most"), F.min_by(F.struct("n", "record"), "at").alias("first")
    )
    return per_split.groupBy("path").agg(F.max("most").alias("most"), F.min_by("first", "start").alias("first"))


def failing_files(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", multiline: bool = True) -> DataFrame:
    """Files that do not parse with `delimiter`: some record has more fields than the first one; `path`."""
    return _headers(records(spark, paths, delimiter, multiline)).where(F.col("most") > F.col("first.n")).select("path")


def surplus_records(spark: SparkSession, paths: str | Sequence[str], delimiter: str = ",", multiline: bool = True) -> DataFrame:
    """Records with more fields than the first one of their file; `path`, `record`. A table keeps only the first fields."""
    found = records(spark, paths, delimiter, multiline)
    first = _headers(found).select("path", F.col("first.n").alias("fields"))
    return found.join(first, "path").where(F.col("n") > F.col("fields")).select("path", "record")


def read_tables(
    spark: SparkSession, paths: Sequence[str], multiline: bool = True, always: bool = False
) -> dict[tuple[str, str], DataFrame]:
    """One table per (delimiter, header line) in use: only files with the same header are read together.

    Files are read with commas, and only those that do not parse so get another delimiter: a file whose records hold no
    comma at all stays a table of one column. With `always`, the delimiter of every file is looked for. The list of
    files, not their content, passes through the driver, as it does in every scan.
    """
    files = _headers(records(spark, paths, ",", multiline))
    failing = F.lit(True) if always else F.col("most") > F.col("first.n")
    by_group = (
        files.join(sniff_delimiters(spark, paths, multiline), "path", "left")
        .select("path", F.when(failing, F.col("delimiter")).otherwise(",").alias("delimiter"), F.col("first.record").alias("header"))
        .groupBy("delimiter", "header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    )
    return {
        (r["delimiter"], r["header"]): read_text_table(spark, r["paths"], r["delimiter"], multiline=multiline)
        for r in by_group.orderBy("delimiter", "header").collect()
    }


def read_by_delimiter(
    spark: SparkSession, paths: Sequence[str], multiline: bool = True, always: bool = False
) -> dict[str, DataFrame]:
    """`read_tables` with the tables of a delimiter put together by column names; missing columns are null."""
    result: dict[str, DataFrame] = {}
    for (delimiter, _), table in read_tables(spark, paths, multiline, always).items():
        result[delimiter] = result[delimiter].unionByName(table, allowMissingColumns=True) if delimiter in result else table
    return result


def with_row_index(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Number the rows of a file source from 0 in file order, for tables without a key.

    Counts per file split give the offsets, which are broadcast if their number is known to be small.
    """
    split = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
    numbered = df.select("*", *[c.alias(n) for n, c in split.items()]).withColumn(MONO_ID, F.monotonically_increasing_id())
    pieces = numbered.groupBy("_file", "_start").agg(
        F.count(F.lit(1)).alias("_rows"), F.min(MONO_ID).alias("_first")
    )
    # One row per file split.
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return (
        numbered.join(F.broadcast(offsets) if few_splits(df) else offsets, ["_file", "_start"])
        .withColumn(name, F.col(MONO_ID) - F.col("_first") + F.col("_before"))
        .drop("_file", "_start", MONO_ID, "_first", "_before")
    )


def preview_rows(df: DataFrame, row_key: Sequence[str], rows: int = 20) -> DataFrame:
    return df.orderBy(*row_key).limit(rows)
