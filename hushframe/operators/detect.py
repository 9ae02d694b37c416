"""Detection in table cells and in text lines; row-local, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.masking import mask_value
from hushframe.functions.text import canonical_text, is_atomic, lines_of, once, strip
from hushframe.modes import PrivacyMode, parse_mode
from hushframe.operators import rules
from hushframe.operators.marks import marks_of

CELL_FIELDS = ("column_ord", "column", "raw", "findings")
FINDING_FIELDS = (
    "dataset", "column_ord", "column", "pii_type", "rule", "confidence", "masked_preview", "raw_value", "rule_order",
)
FLAG_NAMES = ("name", "address", "rc", "birth", "timestamp")


def detectable_columns(df: DataFrame) -> list[tuple[int, str]]:
    """Position and name of the columns whose values have a text form."""
    return [(i, f.name) for i, f in enumerate(df.schema.fields) if is_atomic(f.dataType)]


def check_row_key(df: DataFrame, row_key: Sequence[str], reserved: Sequence[str]) -> list[str]:
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    missing = [k for k in keys if k not in df.columns]
    clash = [k for k in keys if k in reserved]
    if not keys or missing or clash:
        raise ValueError(f"row key {keys}: missing columns {missing}, reserved names {clash}")
    return keys


def named(columns: Sequence[str]) -> list[Column]:
    """Columns by name, whatever characters the name holds."""
    return [F.col(f"`{c}`") for c in columns]


def _flags(df: DataFrame, columns: list[tuple[int, str]]) -> dict[str, Column]:
    """Per flag, a test of the column number against the columns that carry it."""
    carriers = {
        flag: [i for i, name in columns if getattr(rules.column_flags(name), flag)] for flag in FLAG_NAMES
    }
    carriers["text"] = [i for i, name in columns if isinstance(df.schema[name].dataType, T.StringType)]
    return {flag: F.col("column_ord").isin(ords) if ords else F.lit(False) for flag, ords in carriers.items()}


def text_cells(df: DataFrame, keep: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The non-blank cells of some columns as rows: `keep`, `column_ord`, `column`, `raw` and the stripped `cell`.

    The cells of a row become rows within the same stage, so the size of the plan does not grow with their number.
    """
    cells = F.array(
        *[
            F.struct(
                F.lit(df.columns.index(name)).alias("column_ord"), F.lit(name).alias("column"),
                canonical_text(F.col(f"`{name}`"), df.schema[name].dataType).alias("raw"),
            )
            for name in names
        ]
    )
    rows = df.select(*[F.col(f"`{k}`") for k in keep], F.inline(cells)).where(F.col("raw").isNotNull())
    return rows.select("*", once(cell=strip(F.col("raw")))).where(F.col("cell") != "")


def detect_cells(
    df: DataFrame,
    row_key: Sequence[str],
    mode: str | PrivacyMode,
    as_of: date | str | None = None,
    rc_extended_months: bool = False,
    safe: DataFrame | None = None,
    dataset: str = "table",
    skip: Sequence[str] = (),
) -> DataFrame:
    """One row per cell with findings: row key, column, unstripped text and its findings in rule order.

    `safe` marks findings of a `dataset` and `mode` that the Strict mode leaves out: row key, `column`, `pii_type`,
    `rule`. Columns in `skip` are not looked at. Nested and binary columns have no cells.
    """
    mode = parse_mode(mode)
    keys = check_row_key(df, row_key, CELL_FIELDS + FINDING_FIELDS)
    columns = [(i, name) for i, name in detectable_columns(df) if name not in skip]
    flags = _flags(df, columns)
    by_name_alone = flags["name"] | flags["address"] | flags["rc"]
    with_hints = mode is PrivacyMode.STRICT
    found_by = rules.cell_rules(
        F.col("cell"), F.col("digits"), flags, mode, rules.as_of_column(as_of), rc_extended_months
    )
    found = (
        text_cells(df, keys, [name for _, name in columns])
        .where(by_name_alone | rules.gate(F.col("cell"), with_hints))
        .withColumn("digits", rules.digit_count(F.col("cell")))
        .select(*named(keys), "column_ord", "column", "raw", once(mask=rules.rule_mask(found_by)))
        .where(F.col("mask") != 0)
        .withColumn("findings", rules.findings_of_mask(F.col("mask"), found_by))
    )
    if safe is not None:
        found = without_marked(found, keys, safe, dataset, mode)
    return found.select(*named(keys), *CELL_FIELDS)


def without_marked(cells: DataFrame, row_key: Sequence[str], safe: DataFrame, dataset: str, mode: PrivacyMode) -> DataFrame:
    """Leave out the findings that marks of this dataset and mode name, and cells that keep none."""
    place = [*row_key, "column"]
    marks = marks_of(safe, dataset, mode, place)
    if marks is None:
        return cells
    alias = {c: f"_mark_{i}" for i, c in enumerate(place)}
    marks = marks.groupBy(*[F.col(f"`{c}`").alias(a) for c, a in alias.items()]).agg(
        F.collect_set(F.concat_ws("|", "pii_type", "rule")).alias("_marks")
    )
    same = [F.col(f"`{c}`").eqNullSafe(F.col(a)) for c, a in alias.items()]
    is_marked = lambda f: F.array_contains(F.col("_marks"), F.concat_ws("|", f["pii_type"], f["rule"]))
    left = F.when(F.col("_marks").isNull(), F.col("findings")).otherwise(F.filter("findings", lambda f: ~is_marked(f)))
    joined = cells.join(marks, same, "left").withColumn("findings", left).where(F.size("findings") > 0)
    return joined.select(*named(cells.columns))


def findings_of_cells(cells: DataFrame, dataset: str = "table", email_pattern: str | None = None) -> DataFrame:
    """One row per finding. Order of the findings: `column_ord`, row key, `rule_order`."""
    keys = [c for c in cells.columns if c not in CELL_FIELDS]
    value = strip(F.col("raw"))
    return cells.select(
        F.lit(dataset).alias("dataset"), *named(keys), "column_ord", "column", F.inline("findings"), value.alias("raw_value")
    ).select(
        "dataset", *named(keys), "column_ord", "column", "pii_type", "rule", "confidence",
        mask_value(F.col("raw_value"), F.col("pii_type"), email_pattern).alias("masked_preview"),
        "raw_value", "rule_order",
    )


def detect_table(
    df: DataFrame,
    row_key: Sequence[str],
    mode: str | PrivacyMode,
    as_of: date | str | None = None,
    dataset: str = "table",
    rc_extended_months: bool = False,
    mask_scope: str = "cell",
) -> DataFrame:
    """The findings table of a table; `raw_value` is restricted and stays out of reports and audits."""
    cells = detect_cells(df, row_key, mode, as_of, rc_extended_months)
    return findings_of_cells(cells, dataset, rules.EMAIL if mask_scope == "match" else None)


def detect_text(
    df: DataFrame,
    key: Sequence[str],
    text: str,
    mode: str | PrivacyMode,
    as_of: date | str | None = None,
    dataset: str = "text",
) -> DataFrame:
    """The findings table of a corpus of one text per row; `line_no` counts from 1, `match_no` orders a line."""
    mode = parse_mode(mode)
    keys = check_row_key(df, key, ("line_no", "line", "match_no", *FINDING_FIELDS))
    with_hints = mode is not PrivacyMode.RELAXED
    lines = df.select(*named(keys), F.posexplode(lines_of(F.col(text))).alias("line_no", "line")).where(
        rules.gate(F.col("line"), with_hints)
    )
    findings = rules.line_findings(F.col("line"), mode, rules.as_of_column(as_of))
    return (
        lines.select(*named(keys), (F.col("line_no") + 1).cast("bigint").alias("line_no"), F.posexplode(findings))
        .select(*named(keys), "line_no", F.col("pos").alias("match_no"), "col.*")
        .select(
            F.lit(dataset).alias("dataset"), *named(keys), "line_no", "match_no", F.lit("text").alias("column"),
            "pii_type", "rule", "confidence",
            mask_value(F.col("raw_value"), F.col("pii_type")).alias("masked_preview"), "raw_value", "rule_order",
        )
    )
