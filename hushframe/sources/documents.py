"""Text files: whole texts, one row per file, or lines of files of any size, read split by split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.functions.text import RARE_LINE_END, decode_utf8, word_count
from hushframe.sources.split_csv import beside_splits, scan_lines
from hushframe.storage import written

# Fixed value: characters of a preview.
PREVIEW_CHARS = 5000


def read_documents(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """Path and text of each file: UTF-8 without invalid bytes, with newlines as the only line ends."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    content = files.load(paths if isinstance(paths, str) else list(paths))
    return content.select(
        F.regexp_replace("path", "^file:(?=/)", "").alias("path"), decode_utf8(F.col("content")).alias("text")
    )


def _decoded(line: Column) -> Column:
    """A line of the scan as text. A carriage return before the line end belongs to it; any other is a line end of its own."""
    return decode_utf8(F.regexp_replace(line, r"\r\z", "").cast("binary"))


def _parts(text: Column) -> Column:
    """How many lines a line of the scan is, since there are other line ends than the newline."""
    return (F.regexp_count(text, F.lit(f"\n|{RARE_LINE_END}")) + 1).cast("bigint")


def read_text_lines(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(path, line_no, text) of the lines of each file, and (path, char_count, line_count, word_count) of the files.

    Files are read split by split, so a large one runs in many tasks, and no row holds a whole file. `line_no` counts
    from 1 as in the whole text; where a newline is not the only line end, a row holds several lines and `line_no` is that
    of the first. One row per split gives the offsets. A file of 0 bytes is absent.
    """
    scan = scan_lines(spark, paths)
    lines = scan.select(
        "path", "start", "id", _decoded(F.col("line")).alias("text"), (F.octet_length("line") + 1).alias("bytes"),
        F.endswith(F.col("line"), F.lit("\r")).alias("return"),
    )
    lines = lines.withColumns({"parts": _parts(F.col("text")), "odd": F.col("text").rlike(f"(?:\n|{RARE_LINE_END})\\z")})
    per_split = written(
        lines.groupBy("path", "start").agg(
            F.min("id").alias("first_id"), F.count("*").alias("lines"), F.sum("parts").alias("parts"), F.sum("bytes").alias("bytes"),
            F.sum(F.length("text")).alias("chars"), F.sum(word_count(F.lower("text"))).alias("words"), F.max_by("odd", "id").alias("odd"), F.max_by("return", "id").alias("return"),
        ), "text-splits",
    )
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_split.select("path", "start", "first_id", (F.col("parts") > F.col("lines")).alias("uneven"), F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("offset"))
    placed = beside_splits(lines.select("path", "start", "id", "text", "parts"), offsets)
    even = placed.filter("not uneven").select("path", (F.col("offset") + F.col("id") - F.col("first_id") + 1).alias("line_no"), "text")
    if not per_split.filter("parts > lines").isEmpty():
        own = Window.partitionBy("path", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        number = F.col("offset") + F.coalesce(F.sum("parts").over(own), F.lit(0)) + 1
        even = even.unionByName(placed.filter("uneven").select("path", number.alias("line_no"), "text"))
    return even, _file_counts(spark, paths, per_split)


def _file_counts(spark: SparkSession, paths: str | Sequence[str], per_split: DataFrame) -> DataFrame:
    """Counts of whole files. Their size tells whether the last line has an end, and whether a byte order mark came first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths if isinstance(paths, str) else list(paths))
    sizes = files.select(F.regexp_replace("path", "^file:(?=/)(//)?", "").alias("path"), F.col("length").alias("size"))
    total = per_split.groupBy("path").agg(
        *[F.sum(c).alias(c) for c in ("lines", "parts", "bytes", "chars", "words")], F.max_by("odd", "start").alias("odd"),
        F.max_by("return", "start").alias("return"),
    )
    rest = F.col("size") - F.col("bytes")
    # A carriage return at the very end is a line end, too.
    mark, unended = (rest >= 2).cast("bigint"), (rest.isin(-1, 2) & ~F.col("return")).cast("bigint")
    return total.join(sizes, "path").select(
        "path", (F.col("chars") + F.col("lines") - unended + mark).alias("char_count"),
        (F.col("parts") - F.when(F.col("odd"), unended).otherwise(0)).alias("line_count"), F.col("words").alias("word_count"),
    )


def preview_text(df: DataFrame, key: Sequence[str], text: str, chars: int = PREVIEW_CHARS) -> DataFrame:
    return df.select(*key, F.substring(F.col(text), 1, chars).alias("preview"))
