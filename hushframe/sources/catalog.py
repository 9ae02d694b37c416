"""Catalog of the files below a folder, with filters that reach the file scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Supported extensions and the default upper size of a size filter.
EXTENSIONS = (".csv", ".txt", ".md")
DEFAULT_MAX_KB = 10240
CATALOG_SCHEMA = "path string, name string, extension string, size_bytes bigint, modified_at timestamp"


def extension_of(name: Column) -> Column:
    """The last suffix in lower case, with its dot; a name without one, or only with a leading dot, has none."""
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def kind_of(name: Column) -> Column:
    """Tables are `csv`, all other files are `text`."""
    return F.when(extension_of(name) == ".csv", "csv").otherwise("text")


def size_bounds(min_kb: int = 0, max_kb: int = DEFAULT_MAX_KB) -> tuple[int, int]:
    return min_kb * 1024, max_kb * 1024


def size_filter(size: Column, min_size: int | None = None, max_size: int | None = None) -> Column:
    """Both bounds are inclusive, and each may be open."""
    keep = F.lit(True)
    if min_size is not None:
        keep = keep & (size >= min_size)
    if max_size is not None:
        keep = keep & (size <= max_size)
    return keep


def time_filter(
    modified: Column, first: datetime | str | None = None, last: datetime | str | None = None
) -> Column:
    """Both bounds are inclusive, and each may be open."""
    keep = F.lit(True)
    if first is not None:
        keep = keep & (modified >= F.lit(str(first)).cast("timestamp_ntz"))
    if last is not None:
        keep = keep & (modified <= F.lit(str(last)).cast("timestamp_ntz"))
    return keep


def day_filter(modified: Column, first: date | str, last: date | str) -> Column:
    """From the start of the first day to the end of the last one; swapped days are put in order."""
    first, last = sorted(date.fromisoformat(str(d)) for d in (first, last))
    start = F.lit(str(first)).cast("timestamp_ntz")
    end = F.date_add(F.lit(str(last)).cast("date"), 1).cast("timestamp_ntz")
    return (modified >= start) & (modified < end)


def _is_folder(spark: SparkSession, root: str) -> bool:
    """False for a missing path and for a file; any other trouble is raised."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.exists(path) and files.getFileStatus(path).isDirectory()


def _empty_files(spark: SparkSession, files: DataFrame, supported: Sequence[str]) -> DataFrame:
    """The files of 0 bytes among those of a scan, which gives no row for them.

    The scan has listed all paths at the driver already; what its rows lack is looked up there, for supported names only.
    """
    ends = tuple(e.lower() for e in supported)
    listed = spark.createDataFrame([(p,) for p in files.inputFiles() if p.lower().endswith(ends)], "uri string")
    # Paths of the listing are URIs, those of the rows are not.
    path = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))
    seen = files.select(_plain(F.col("path")).alias("key"))
    lost = listed.select(path.alias("path"), _plain(path).alias("key")).join(seen, "key", "left_anti").collect()
    made, conf = [], spark._jsparkSession.sessionState().newHadoopConf()
    for r in lost:
        file = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
        status = file.getFileSystem(conf).getFileStatus(file)
        if status.getLen() == 0:
            made.append((r["path"], 0, datetime.fromtimestamp(status.getModificationTime() / 1000, UTC)))
    return spark.createDataFrame(made, "path string, length bigint, modificationTime timestamp")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def file_catalog(
    spark: SparkSession,
    root: str | None,
    recursive: bool = True,
    search: str | None = None,
    file_types: Sequence[str] | None = None,
    size_range: tuple[int | None, int | None] | None = None,
    modified_range: tuple[datetime | str | None, datetime | str | None] | None = None,
    supported: Sequence[str] = EXTENSIONS,
) -> DataFrame:
    """Path, name, extension, size and time of the supported files, newest first; files of 0 bytes, too.

    The content column is pruned, so no file is read. Names that start with `_` or `.` are not listed.
    """
    empty = spark.createDataFrame([], CATALOG_SCHEMA)
    if not (root or "").strip() or not _is_folder(spark, root):
        return empty
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not recursive:
        # Folders named like partitions would be descended into as well.
        files = files.option("basePath", root)
    files = files.load(root)
    files = files.select("path", "length", "modificationTime").unionByName(_empty_files(spark, files, supported))
    path = _plain(F.col("path"))
    name = F.element_at(F.split("path", "/"), -1)
    wanted = sorted({e.lower() for e in supported} & {e.lower() for e in (file_types or supported)})
    keep = extension_of(name).isin(wanted) if wanted else F.lit(False)
    needle = (search or "").strip().lower()
    if needle:
        keep = keep & F.contains(F.lower(name), F.lit(needle))
    keep = keep & size_filter(F.col("length"), *(size_range or (None, None)))
    keep = keep & time_filter(F.col("modificationTime"), *(modified_range or (None, None)))
    return (
        files.where(keep)
        .select(
            path.alias("path"), name.alias("name"), extension_of(name).alias("extension"),
            F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
        )
        .orderBy(F.desc("modified_at"), "path")
    )
