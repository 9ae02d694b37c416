"""Exports of anonymized tables and texts; each is a folder of part files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame

# Fixed value: ending of an export's name.
EXPORT_SUFFIX = "_anonymized.csv"


def export_name(source: str) -> str:
    return f"{PurePosixPath(source).stem}{EXPORT_SUFFIX}"


def export_table(table: DataFrame, folder: str, source: str, mode: str = "errorifexists") -> str:
    """Write the table as UTF-8 CSV with a header below `folder`, named after its source; returns the path."""
    path = f"{folder.rstrip('/')}/{export_name(source)}"
    table.write.mode(mode).options(header="true", quote='"', escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return path


def export_texts(texts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    texts.write.mode(mode).parquet(path)
