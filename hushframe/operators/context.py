"""Bounded, privacy-scoped release payloads."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.text import is_atomic, lines_of, once, without_nan
from hushframe.modes import SAMPLE_LIMIT, ContextScope, PrivacyMode, parse_mode, parse_scope
from hushframe.operators import profile_table
from hushframe.operators.anonymize_text import anonymize_text
from hushframe.operators.profile_text import keywords_column, text_counts

# Names of identifier columns, when such a column is dropped, payload limit and payload instruction.
ID_NAMES = ("id", "user_id", "customer_id", "uuid", "guid", "account_id", "person_id")
ID_SUFFIX = "_id"
ID_DISTINCT_RATIO = 0.95
ID_MIN_VALUES = 50
PAYLOAD_LIMIT_BYTES = 200 * 1024
INSTRUCTION = "Respond in Czech and only use the provided context."

# Share by which an approximate distinct count may be off before the exact one is asked for.
APPROXIMATE_SLACK = 0.1


def id_candidates(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if (f.name.lower() in ID_NAMES or f.name.lower().endswith(ID_SUFFIX)) and is_atomic(f.dataType)
    ]


def id_like_columns(df: DataFrame) -> DataFrame:
    """Count the columns with an identifier name: `column`, `non_null`, `distinct_values`, `dropped`.

    The values are grouped per column and counted before the shuffle, so one pass serves all candidates.
    """
    names = id_candidates(df)
    schema = "column string, non_null bigint, distinct_values bigint, dropped boolean"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                without_nan(F.col(f"`{c}`"), df.schema[c].dataType).cast("string").alias("value"),
            )
            for c in names
        ]
    )
    per_value = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    counted = per_value.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("non_null"),
        F.count_if(present).alias("distinct_values"),
    )
    ratio = F.try_divide(F.col("distinct_values"), F.col("non_null"))
    dropped = (F.col("non_null") >= ID_MIN_VALUES) & (ratio >= ID_DISTINCT_RATIO)
    return counted.withColumn("dropped", F.coalesce(dropped, F.lit(False)))


def columns_to_drop(df: DataFrame) -> list[str]:
    """Names of the identifier columns that a Strict sample leaves out.

    A sketch decides where it is far from the limit; only a column near it is counted exactly.
    """
    names = id_candidates(df)
    if not names:
        return []
    aggregates = []
    for i, c in enumerate(names):
        value = without_nan(F.col(f"`{c}`"), df.schema[c].dataType)
        aggregates += [F.count(value).alias(f"n{i}"), F.approx_count_distinct(value, 0.01).alias(f"d{i}")]
    row = df.agg(*aggregates).first()
    drop, near = [], []
    for i, c in enumerate(names):
        n, d = row[f"n{i}"], row[f"d{i}"]
        if n < ID_MIN_VALUES or d < (ID_DISTINCT_RATIO - APPROXIMATE_SLACK) * n:
            continue
        near.append(c)
    if near:
        exact = id_like_columns(df.select(*[F.col(f"`{c}`") for c in near]))
        drop = [r["column"] for r in exact.where("dropped").collect()]
    return [c for c in names if c in drop]


def sample_rows(
    df: DataFrame, row_key: Sequence[str], mode: str | PrivacyMode, hidden: Sequence[str] = ()
) -> DataFrame:
    """The first rows by row key, as many as the mode allows; Strict leaves identifier columns out.

    Nested and binary columns stay out in every mode: detection can't look into them, so nothing of them is released.
    Copies of the row key (`_sample_order_0`, ...) follow the columns. `hidden` columns are left out.
    """
    mode = parse_mode(mode)
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    unseen = [f.name for f in df.schema.fields if not is_atomic(f.dataType)]
    drop = [*hidden, *unseen, *(columns_to_drop(df.drop(*hidden)) if mode is PrivacyMode.STRICT else [])]
    ordered = [F.col(f"`{k}`").alias(f"_sample_order_{i}") for i, k in enumerate(keys)]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in drop]
    return (
        df.select(*kept, *ordered)
        .orderBy(*[f"_sample_order_{i}" for i in range(len(keys))])
        .limit(SAMPLE_LIMIT[mode])
    )


def _sample_array(df: DataFrame, row_key: Sequence[str], mode: PrivacyMode, hidden: Sequence[str]) -> DataFrame:
    sample = sample_rows(df, row_key, mode, hidden)
    order = [c for c in sample.columns if c.startswith("_sample_order_")]
    fields = [without_nan(F.col(f"`{c}`"), sample.schema[c].dataType).alias(c) for c in sample.columns if c not in order]
    ranked = sample.select(F.struct(*order).alias("at"), F.struct(*fields).alias("row"))
    # At most as many rows as the mode allows.
    rows = F.transform(F.sort_array(F.collect_list(F.struct("at", "row"))), lambda r: r["row"])
    return ranked.agg(rows.alias("sample_rows")).withColumn("sample_row_count", F.size("sample_rows").cast("bigint"))


def table_profile(
    df: DataFrame, scope: str | ContextScope = ContextScope.SCHEMA_STATS, decimals: int | None = None
) -> DataFrame:
    """The part of a table profile that a scope releases, one row: never the top values.

    Each part comes from an aggregation with one row or one row per column.
    """
    scope = parse_scope(scope)
    listed = [(i, f.name, profile_table.type_name(f.dataType)) for i, f in enumerate(df.schema.fields)]
    schema = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(t).alias("dtype")) for _, n, t in listed])
    if scope is ContextScope.SCHEMA:
        return df.sparkSession.range(1).select(F.struct(schema.alias("schema")).alias("profile"))
    missing = profile_table.missing(df)
    counts = missing.agg(
        F.max("row_count").alias("row_count"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("column_ord", "column", "missing"))),
            lambda m: F.struct(m["column"].alias("column"), m["missing"].alias("missing")),
        ).alias("missing"),
    )
    shown = (lambda c: F.round(c, decimals)) if decimals is not None else (lambda c: c)
    numbers = ("min", "max", "mean", "median")
    stats = profile_table.numeric_stats(df).agg(
        F.sort_array(
            F.collect_list(
                F.struct("column_ord", "column", F.struct(*[shown(F.col(n)).alias(n) for n in numbers]).alias("stats"))
            )
        ).alias("stats")
    )
    duplicates = profile_table.duplicate_rows(df)
    one_row = counts.withColumn("_one", F.lit(1))
    for part in (stats, duplicates):
        one_row = one_row.join(F.broadcast(part.withColumn("_one", F.lit(1))), "_one")
    return one_row.select(
        F.struct(
            schema.alias("schema"),
            F.col("row_count"),
            F.lit(len(listed)).cast("bigint").alias("column_count"),
            F.map_from_entries("missing").alias("missing_by_column"),
            F.map_from_entries(
                F.transform("stats", lambda s: F.struct(s["column"].alias("column"), s["stats"].alias("stats")))
            ).alias("numeric_stats"),
            F.col("duplicate_rows"),
        ).alias("profile")
    )


def table_context(
    df: DataFrame,
    row_key: Sequence[str],
    mode: str | PrivacyMode,
    scope: str | ContextScope,
    dataset: str = "table",
    decimals: int | None = None,
    hidden: Sequence[str] = (),
) -> DataFrame:
    """One row: `dataset`, `file_kind`, `privacy_mode`, `scope`, `profile`, and with a sample `sample_rows` and
    `sample_row_count`."""
    mode, scope = parse_mode(mode), parse_scope(scope)
    head = [
        F.lit(dataset).alias("dataset"), F.lit("csv").alias("file_kind"), F.lit(mode.value).alias("privacy_mode"),
        F.lit(scope.value).alias("scope"),
    ]
    profile = table_profile(df.drop(*hidden), scope, decimals)
    if scope is not ContextScope.SCHEMA_STATS_SAMPLE:
        return profile.select(*head, "profile")
    sample = _sample_array(df, row_key, mode, hidden).withColumn("_one", F.lit(1))
    joined = profile.withColumn("_one", F.lit(1)).join(F.broadcast(sample), "_one")
    return joined.select(*head, "profile", "sample_row_count", "sample_rows")


def text_context(
    df: DataFrame,
    key: Sequence[str],
    text: str,
    mode: str | PrivacyMode,
    scope: str | ContextScope,
    released: str | None = None,
    profile_source: str = "released",
    as_of: date | str | None = None,
) -> DataFrame:
    """One row per text: its profile under every scope, and with a sample its first lines.

    `released` names the column with the version to release; by default the text itself is released. The profile is
    that of the released version, so that no keyword leaks, or with `profile_source='original'` that of `text`.
    """
    mode, scope = parse_mode(mode), parse_scope(scope)
    keys = [key] if isinstance(key, str) else list(key)
    released = released or text
    source = released if profile_source == "released" else text
    value = F.coalesce(F.col(source), F.lit(""))
    counted = text_counts(
        df.select(*keys, F.col(source), F.coalesce(F.col(released), F.lit("")).alias("_released")),
        [*keys, F.col("_released"), keywords_column(value).alias("keywords")],
        source,
    )
    columns = [
        *keys, F.lit("text").alias("file_kind"), F.lit(mode.value).alias("privacy_mode"),
        F.lit(scope.value).alias("scope"),
        F.struct("char_count", "line_count", "word_count", "keywords").alias("profile"),
    ]
    if scope is not ContextScope.SCHEMA_STATS_SAMPLE:
        return counted.select(*columns)
    limit = SAMPLE_LIMIT[mode]
    sample = F.slice(lines_of(F.col("_released")), 1, limit).alias("sample_rows")
    return counted.select(*columns, sample).withColumn("sample_row_count", F.size("sample_rows").cast("bigint"))


def indented_bytes(json: Column) -> Column:
    """UTF-8 bytes that a compact JSON text takes when it is printed with an indent of two.

    Only brackets, commas and colons matter for the difference; a fold over them keeps the depth.
    """
    plain = F.regexp_replace(json, r"\\.", "")
    scalar = r'"[^"]*"|[^{}\[\],:"]+'
    shape = F.regexp_replace(F.regexp_replace(plain, scalar, "s"), r"\{\}|\[\]", "s")
    marks = F.split(F.regexp_replace(shape, "s", ""), "")

    def step(done: Column, mark: Column) -> Column:
        opens, closes = mark.isin("{", "["), mark.isin("}", "]")
        depth = done["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        extra = F.when(mark == ":", 1).when(mark == "", 0).otherwise(1 + 2 * depth)
        return F.struct(depth.cast("int").alias("depth"), (done["extra"] + extra).cast("bigint").alias("extra"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("extra"))
    return F.octet_length(json) + F.aggregate(marks, start, step, lambda done: done["extra"])


def release_payload(context: DataFrame, task: Column, limit_bytes: int = PAYLOAD_LIMIT_BYTES) -> DataFrame:
    """Reshape a context into its payload and guard its size.

    A payload above `limit_bytes` loses its sample (`truncated`); it is not cut further, and `still_over` says that it
    stays above the limit. The payload is compact JSON; its size, `payload_bytes`, is that of the indented form.
    """
    profile = context.schema["profile"].dataType
    stats = [F.col("profile")[f.name].alias(f.name) for f in profile.fields if f.name != "schema"]
    schema = F.col("profile")["schema"] if "schema" in profile.fieldNames() else F.array()
    parts = [schema.alias("schema"), (F.struct(*stats) if stats else F.create_map()).alias("stats")]
    sample = F.col("sample_rows") if "sample_rows" in context.columns else F.array()
    options = {"ignoreNullFields": "false"}

    def payload(*dataset: Column) -> Column:
        return F.to_json(
            F.struct(
                task.alias("task"), F.struct(*dataset).alias("dataset"),
                F.array(F.lit(INSTRUCTION)).alias("analysis_scope"),
            ),
            options,
        )

    keys = [c for c in context.columns if c not in ("profile", "sample_rows", "sample_row_count")]
    both = context.select(*keys, once(full=payload(*parts, sample.alias("sample")), short=payload(*parts)))
    sized = both.select(*keys, "full", "short", once(full_bytes=indented_bytes(F.col("full"))))
    over = F.col("full_bytes") > limit_bytes
    kept = sized.select(
        *keys, F.when(over, F.col("short")).otherwise(F.col("full")).alias("payload"), over.alias("truncated"),
        once(payload_bytes=F.when(over, indented_bytes(F.col("short"))).otherwise(F.col("full_bytes"))),
    )
    return kept.withColumn("still_over", F.col("payload_bytes") > limit_bytes)


def released_text(
    df: DataFrame,
    text: str,
    mode: str | PrivacyMode,
    as_of: date | str | None = None,
    safe: DataFrame | None = None,
    key: Sequence[str] = (),
    dataset: str = "text",
) -> DataFrame:
    """Add `released`, the anonymized version of a text, next to the original."""
    return anonymize_text(df.withColumn("released", F.col(text)), "released", mode, as_of, safe, key, dataset)
