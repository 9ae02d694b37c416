"""Consistent tokens for the values found in texts; everything happens inside the row of a text."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.text import let, lines_of
from hushframe.modes import PrivacyMode, parse_mode
from hushframe.operators import rules
from hushframe.operators.marks import marks_of

TEXT_TYPES = ("EMAIL", "PHONE", "RC", "BANK", "DOB", "ADDRESS")


MARKS = "_marks"


def _found_values(text: Column, mode: PrivacyMode, as_of: Column, marks: Column | None) -> Column:
    """The found values of a text in finding order, as array<struct<pii_type,raw>>.

    `marks` is an array of `line|type|rule` texts; findings that they name are left out.
    """
    with_hints = mode is not PrivacyMode.RELAXED
    lines = F.transform(lines_of(text), lambda line, i: F.struct(line.alias("line"), (i + 1).alias("line_no")))
    worth = F.filter(lines, lambda at: rules.gate(at["line"], with_hints))

    def of_line(at: Column) -> Column:
        found = rules.line_findings(at["line"], mode, as_of)
        if marks is None:
            return found
        return F.filter(
            found,
            lambda f: ~F.array_contains(marks, F.concat_ws("|", at["line_no"].cast("string"), f["pii_type"], f["rule"])),
        )

    found = F.flatten(F.transform(worth, of_line))
    return F.transform(found, lambda f: F.struct(f["pii_type"].alias("pii_type"), f["raw_value"].alias("raw")))


def _with_marks(df: DataFrame, key: Sequence[str], own: DataFrame) -> DataFrame:
    """Add the marks of each text; a text has no more of them than findings."""
    mark = F.concat_ws("|", F.col("line_no").cast("string"), "pii_type", "rule")
    alias = {k: f"_key_{i}" for i, k in enumerate(key)}
    marks = own.groupBy(*[F.col(f"`{k}`").alias(a) for k, a in alias.items()]).agg(F.collect_set(mark).alias(MARKS))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(a)) for k, a in alias.items()]
    empty = F.array().cast("array<string>")
    return df.join(marks, same, "left").withColumn(MARKS, F.coalesce(F.col(MARKS), empty))


def _entries(found: Column) -> Column:
    """The tokens of a text in replacement order: longer values first, then by first appearance.

    Each type numbers its distinct values in that order. Sorting by value brings repeats together, so a text with
    many findings costs no more than its sorts.
    """

    def distinct(by_value: Column) -> Column:
        def is_first(entry: Column, i: Column) -> Column:
            before = F.get(by_value, i - 1)
            return (i == 0) | (before["pii_type"] != entry["pii_type"]) | (before["raw"] != entry["raw"])

        return F.filter(by_value, is_first)

    def number(ordered: Column) -> Column:
        def of_type(pii_type: str) -> Column:
            return F.transform(
                F.filter(ordered, lambda e: e["pii_type"] == pii_type),
                lambda e, i: F.struct(
                    e["minus_length"].alias("minus_length"), e["at"].alias("at"), e["pii_type"].alias("pii_type"),
                    e["raw"].alias("raw"), (i + 1).cast("bigint").alias("token_no"),
                    F.concat_ws("_", e["pii_type"], (i + 1).cast("string")).alias("token"),
                ),
            )

        return F.sort_array(F.concat(*[of_type(t) for t in TEXT_TYPES]))

    by_value = F.sort_array(
        F.transform(found, lambda f, i: F.struct(f["pii_type"].alias("pii_type"), f["raw"].alias("raw"), i.alias("at")))
    )
    ordered = F.sort_array(
        F.transform(
            let(by_value, distinct),
            lambda e: F.struct(
                (-F.length(e["raw"])).alias("minus_length"), e["at"].alias("at"), e["pii_type"].alias("pii_type"),
                e["raw"].alias("raw"),
            ),
        )
    )
    return let(ordered, number)


def token_entries(
    text: Column, mode: str | PrivacyMode, as_of: date | str | None = None, marks: Column | None = None
) -> Column:
    """The token entries of a text as one array column; null for a text without a found value."""
    found = _found_values(text, parse_mode(mode), rules.as_of_column(as_of), marks)
    return let(found, lambda f: F.when(F.size(f) > 0, _entries(f)))


def text_dictionary(
    df: DataFrame, key: Sequence[str], text: str, mode: str | PrivacyMode, as_of: date | str | None = None
) -> DataFrame:
    """The token dictionary of every text, one row per token; restricted, as it holds the found values."""
    entries = F.inline(token_entries(F.col(text), mode, as_of))
    return df.select(*key, entries).select(*key, "pii_type", "raw", "token_no", "token")


def _replaced(text: Column, entries: Column) -> Column:
    return F.aggregate(entries, text, lambda done, e: F.replace(done, e["raw"], e["token"]))


def _replaced_counts(text: Column, entries: Column) -> Column:
    """The number of replacements per type that take place, as array<struct<pii_type,replaced>>."""
    start = F.struct(text.alias("text"), *[F.lit(0).cast("bigint").alias(t) for t in TEXT_TYPES])

    def step(done: Column, e: Column) -> Column:
        left = F.length(F.replace(done["text"], e["raw"], F.lit("")))
        hits = ((F.length(done["text"]) - left) / F.length(e["raw"])).cast("bigint")
        return F.struct(
            F.replace(done["text"], e["raw"], e["token"]).alias("text"),
            *[(done[t] + F.when(e["pii_type"] == t, hits).otherwise(F.lit(0))).cast("bigint").alias(t) for t in TEXT_TYPES],
        )

    def pairs(done: Column) -> Column:
        return F.array(*[F.struct(F.lit(t).alias("pii_type"), done[t].alias("replaced")) for t in TEXT_TYPES])

    return F.aggregate(entries, start, step, pairs)


def anonymize_text(
    df: DataFrame,
    text: str,
    mode: str | PrivacyMode,
    as_of: date | str | None = None,
    safe: DataFrame | None = None,
    key: Sequence[str] = (),
    dataset: str = "text",
) -> DataFrame:
    """Replace every found value everywhere in its text, longer ones first; the other columns stay.

    `safe` marks findings of a `dataset` and `mode` that the Strict mode leaves out: the text key `key`, `line_no`,
    `pii_type`, `rule`.
    """
    value, marks, columns = F.col(f"`{text}`"), None, df.columns
    own = None if safe is None else marks_of(safe, dataset, parse_mode(mode), [*key, "line_no"])
    if own is not None:
        df, marks = _with_marks(df, key, own), F.col(MARKS)
    replaced = let(
        token_entries(value, mode, as_of, marks), lambda e: F.when(e.isNull(), value).otherwise(_replaced(value, e))
    )
    return df.withColumn(text, replaced).select(*[F.col(f"`{c}`") for c in columns])


def replaced_counts(
    df: DataFrame, text: str, mode: str | PrivacyMode, as_of: date | str | None = None, key: Sequence[str] = ()
) -> DataFrame:
    """Replacements per type that took place; a value inside a longer replaced one counts nothing."""
    value = F.col(text)
    counted = let(token_entries(value, mode, as_of), lambda e: F.when(e.isNotNull(), _replaced_counts(value, e)))
    return (
        df.select(*key, F.inline(counted))
        .where(F.col("replaced") > 0)
        .groupBy(*key, "pii_type").agg(F.sum("replaced").alias("replaced"))
    )
