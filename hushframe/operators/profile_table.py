"""Profiles of tables: size, schema, missing values, numeric statistics, top values and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.text import canonical_text, is_atomic, is_missing, once, without_nan
from hushframe.storage import written

# Fixed value: values shown per column.
TOP_VALUES = 5

# A value of up to this many characters is counted as it is.
KEY_CHARS = 64
# Up to so many long values that tie are broadcast.
BROADCAST_KEYS = 100_000

# Type names in a schema listing.
TYPE_NAMES = {
    T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64",
    T.FloatType: "float32", T.DoubleType: "float64", T.BooleanType: "bool",
    T.TimestampType: "datetime64[us, UTC]", T.TimestampNTZType: "datetime64[us]",
}

# Search for exact medians: values in which one more aggregation is enough, and buckets that a pass cuts an interval into.
DIRECT_VALUES = 1_000_000
BUCKETS = 2048


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).cast("bigint").alias("column_count")
    )


def type_name(dtype: T.DataType) -> str:
    return TYPE_NAMES.get(type(dtype), "object")


def _labels(df: DataFrame) -> Column:
    """One struct (position, name, type) per column, as an array literal."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("column_ord"), F.lit(f.name).alias("column"), F.lit(type_name(f.dataType)).alias("dtype"))
            for i, f in enumerate(df.schema.fields)
        ]
    )


def missing(df: DataFrame) -> DataFrame:
    """Type, rows and missing values (null or NaN) per column, from one aggregation of one pass."""
    values = [
        F.count_if(is_missing(F.col(f"`{f.name}`"), f.dataType)).alias(f"m{i}") for i, f in enumerate(df.schema.fields)
    ]
    one_row = df.agg(F.count(F.lit(1)).alias("row_count"), *values)
    missing_counts = F.array(*[F.col(f"m{i}") for i in range(len(values))])
    return one_row.select("row_count", F.inline(F.arrays_zip(_labels(df).alias("label"), missing_counts.alias("missing")))).select(
        F.col("label.column_ord"), F.col("label.column"), F.col("label.dtype"), "row_count", "missing"
    )


def schema_listing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, f.name, type_name(f.dataType)) for i, f in enumerate(df.schema.fields)],
        "column_ord int, column string, dtype string",
    )


def _numbers(df: DataFrame) -> dict[int, Column]:
    """Per numeric column, by its position, the present values as doubles."""
    return {
        df.columns.index(name): without_nan(F.col(f"`{name}`"), df.schema[name].dataType).cast("double")
        for name in numeric_columns(df)
    }


def numeric_stats(df: DataFrame, direct_values: int = DIRECT_VALUES) -> DataFrame:
    """Min, max, mean and exact median of the present values per numeric column; all null if there are none.

    One flat aggregation gives all but the medians. A table that it has counted as small gets its medians from one more.
    Otherwise they are selected: a pass counts the values of all columns in buckets, the bucket that holds the middle is
    cut again, and so on until it holds one value. No pass sorts or moves rows, and each brings at most two times `BUCKETS`
    counts per column to the driver, however many rows there are.
    """
    names = {df.columns.index(name): name for name in numeric_columns(df)}
    schema = "column_ord int, column string, min double, max double, mean double, median double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    numbers = _numbers(df)
    parts = []
    for i, value in numbers.items():
        finite = F.when(F.abs(value) < float("inf"), value)
        parts += [
            F.count(value).alias(f"n{i}"), F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}"),
            F.avg(value).alias(f"mean{i}"), F.min(finite).alias(f"low{i}"), F.max(finite).alias(f"high{i}"),
        ]
    row = df.agg(*parts).first()
    present = {i: row[f"n{i}"] for i in numbers}
    if sum(present.values()) <= direct_values:
        medians = df.agg(*[F.median(value).alias(f"m{i}") for i, value in numbers.items()]).first()
        medians = {i: medians[f"m{i}"] for i in numbers}
    else:
        middle = {i: ((n - 1) // 2, n // 2) for i, n in present.items() if n}
        bounds = {i: (row[f"low{i}"] or 0.0, row[f"high{i}"] or 0.0) for i in middle}
        found = _ranked_values(df, middle, bounds)
        medians = {i: _between(found[i, a], found[i, b]) for i, (a, b) in middle.items()}
    rows = [(i, name, row[f"min{i}"], row[f"max{i}"], row[f"mean{i}"], medians.get(i)) for i, name in names.items()]
    return df.sparkSession.createDataFrame(rows, schema)


def _between(low: float, high: float) -> float:
    """The middle of two values, also where their sum is too large for a double."""
    return (low + high) / 2 if abs(low + high) < float("inf") else low / 2 + high / 2


def _bucket(value: Column, low: float, high: float) -> Column:
    """The bucket of a value between two finite bounds, rising with it; the infinite ones lie outside."""
    width = high / 2 - low / 2
    inside = F.when(value > low, BUCKETS - 1).otherwise(0) if width == 0 else F.least(F.floor((value / 2 - low / 2) / width * BUCKETS), F.lit(BUCKETS - 1))
    return F.when(value == float("-inf"), -1).when(value == float("inf"), BUCKETS).otherwise(inside).cast("int")


def _ranked_values(df: DataFrame, ranks: dict[int, tuple[int, int]], bounds: dict[int, tuple[float, float]]) -> dict[tuple[int, int], float]:
    """The values of some ranks (from 0) of columns, by (column, rank).

    An interval is known by its bounds and by how many values lie below; two ranks of a column mostly share theirs.
    """
    numbers, found = _numbers(df), {}
    # The first intervals take everything in, the infinite values, too.
    open_at = {(i, rank): (*bounds[i], 0, True) for i, own in ranks.items() for rank in own}
    while open_at:
        intervals = sorted({(i, *interval) for (i, _), interval in open_at.items()})
        cells = F.array(*[
            F.when(
                numbers[i].isNotNull() if whole else (numbers[i] >= low) & (numbers[i] <= high),
                F.struct(F.lit(at).alias("at"), _bucket(numbers[i], low, high).alias("bucket"), numbers[i].alias("value")),
            )
            for at, (i, low, high, _, whole) in enumerate(intervals)
        ])
        counted = df.select(F.inline(F.array_compact(cells))).groupBy("at", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        buckets: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["at"], r["bucket"])):
            buckets.setdefault(r["at"], []).append(r)
        next_at = {}
        for (i, rank), interval in open_at.items():
            below = interval[2]
            for r in buckets[intervals.index((i, *interval))]:
                if rank < below + r["n"]:
                    if r["low"] == r["high"]:
                        found[i, rank] = r["low"]
                    else:
                        next_at[i, rank] = (r["low"], r["high"], below, False)
                    break
                below += r["n"]
        open_at = next_at
    return found


def _value_key(value: Column) -> Column:
    """A value, or in place of a long one its first characters and its SHA-256; no short value is as long as that."""
    return F.when(F.length(value) <= KEY_CHARS, value).otherwise(
        F.concat(F.substring(value, 1, KEY_CHARS), F.sha2(value, 256))
    )


def top_values(df: DataFrame, limit: int = TOP_VALUES, null_label: str = "nan") -> DataFrame:
    """The most frequent values per column that is neither numeric nor boolean.

    A missing value counts as the text `null_label`. Ties go by value. Long values do not travel: keys (first characters
    and digest) are counted, and ranked by count and first characters. Keys that tie with the last one are all kept, the
    long ones among what is left are looked up in a second pass, and whole values decide. The rankings keep what is in
    reach per column and task before the shuffle.
    """
    columns = [
        (i, f) for i, f in enumerate(df.schema.fields)
        if is_atomic(f.dataType) and not isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    schema = "column_ord int, column string, value string, count bigint, rank int"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("column_ord"),
                        F.lit(f.name).alias("column"),
                        F.coalesce(canonical_text(F.col(f"`{f.name}`"), f.dataType), F.lit(null_label)).alias("value"),
                    )
                    for i, f in columns
                ]
            )
        )
    )
    start = F.substring("key", 1, KEY_CHARS)
    frequent = Window.partitionBy("column_ord", "column").orderBy(F.desc("count"), start)
    near = (
        cells.select("column_ord", "column", _value_key(F.col("value")).alias("key"))
        .groupBy("column_ord", "column", "key").agg(F.count(F.lit(1)).alias("count"))
        .withColumn("rank", F.rank().over(frequent))
        .where(F.col("rank") <= limit)
    )
    near = written(near.select("column_ord", "column", "key", "count"), "top-values")
    long_key = F.length("key") > KEY_CHARS
    named = near.where(~long_key).withColumn("value", F.col("key"))
    wanted = near.where(long_key)
    many = wanted.count()
    if many:
        keys = wanted.select("column_ord", "key")
        long_values = (
            cells.where(F.length("value") > KEY_CHARS)
            .select("column_ord", "value", once(key=_value_key(F.col("value"))))
            .join(F.broadcast(keys) if many <= BROADCAST_KEYS else keys, ["column_ord", "key"], "left_semi")
            .groupBy("column_ord", "key").agg(F.min("value").alias("value"))
        )
        named = named.unionByName(wanted.join(long_values, ["column_ord", "key"]))
    last = Window.partitionBy("column_ord", "column").orderBy(F.desc("count"), "value")
    ranked = named.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= limit)
    return ranked.select("column_ord", "column", "value", "count", "rank")


def duplicate_rows(df: DataFrame, by_digest: bool = False) -> DataFrame:
    """Rows beyond the first of each group of equal rows; nulls are equal to each other.

    Rows are grouped by all their values. With `by_digest`, a SHA-256 of the row takes their place, so that wide
    rows and long texts do not travel.
    """
    if by_digest:
        # As JSON, the row keeps the borders between its values and tells null from an empty text.
        row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        groups = df.select(F.sha2(row, 256).alias("digest")).groupBy("digest").count()
    else:
        groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))
