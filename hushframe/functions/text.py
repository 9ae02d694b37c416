"""String forms of typed values, trimming, lines and words, as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that str.strip() removes, and line ends that str.splitlines() knows.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
RARE_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]+"

# Cell texts that a CSV reader takes for a missing value (the documented pandas defaults).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(**values: Column) -> Column:
    """Columns that are computed once: behind a generator, no filter or projection repeats their expressions."""
    return F.inline(F.array(F.struct(*[value.alias(name) for name, value in values.items()])))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_atomic(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def _double_text(value: Column) -> Column:
    """Shortest decimal form: plain from 1e-4 up to 1e16, else with a signed two-digit exponent."""
    size = F.abs(value)
    native = value.cast("string")
    plain = F.regexp_replace(
        F.regexp_replace(native.cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    mantissa = F.regexp_replace(F.substring_index(native, "E", 1), r"\.0$", "")
    exponent = F.substring_index(native, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(exponent))
    )
    return (
        F.when(F.isnan(value), F.lit(None).cast("string"))
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7)), native)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )


def canonical_text(value: Column, dtype: T.DataType) -> Column:
    """The text of an atomic value as the detector sees it; null and NaN give null."""
    if isinstance(dtype, T.StringType):
        return value
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, T.DoubleType):
        return _double_text(value)
    if isinstance(dtype, T.FloatType):
        # Through text, so that 0.1f reads 0.1 and not 0.10000000149011612.
        return _double_text(value.cast("string").cast("double"))
    return value.cast("string")


def is_missing(value: Column, dtype: T.DataType) -> Column:
    """Null, or NaN in a floating-point column."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def without_nan(value: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def lines_of(text: Column) -> Column:
    """The lines of a text without their ends; a last empty piece is no line, an empty text has none."""
    pieces = F.when(text.rlike(RARE_LINE_END), F.split(text, LINE_END, -1)).otherwise(F.split(text, "\n", -1))
    return let(
        pieces,
        lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts),
    )


def line_count(text: Column) -> Column:
    return (F.regexp_count(text, F.lit(LINE_END)) + F.when(ends_in_line(text), 1).otherwise(0)).cast("bigint")


def ends_in_line(text: Column) -> Column:
    """True if characters follow the last line end."""
    last = F.right(text, F.lit(1))
    return (text != "") & ~last.rlike(f"^(?:{LINE_END})$")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def decode_utf8(content: Column) -> Column:
    """Bytes to text: invalid bytes are dropped and every line end becomes a newline."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))
    return F.regexp_replace(text, r"\r\n?", "\n")


def na_to_null(value: Column) -> Column:
    return F.when(~value.isin(*NA_TOKENS), value)
