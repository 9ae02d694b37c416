"""Consistent tokens for the found cells of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.text import canonical_text
from hushframe.modes import PrivacyMode, parse_mode
from hushframe.operators.detect import detect_cells, detectable_columns, without_marked
from hushframe.operators.ordered import numbered, sorted_once
from hushframe.storage import written

# Tokens that may be matched by broadcast: those of a table that has up to this many bytes of them.
BROADCAST_BYTES = 32 << 20
ENTRY_BYTES = 100
# Number of a row while it is away from its cells.
ROW = "_row_number"
# Wider tables join their tokens back by row, so that the plan stays small.
LOOK_UP_COLUMNS = 40
KEY = ("pii_type", "chain", "raw")
VALUE = ("column_ord", "types", "raw")


@dataclass
class TableDictionary:
    """Tokens of a table; restricted, as they hold the found values: they never join an audit or a context.

    `entries` has one row per token: `pii_type`, `chain` (the types replaced before in the same cell), `raw` (the
    unstripped cell text), `token_no`, `token`, `occurrences`. `values` has one row per column and found text.
    """

    entries: DataFrame
    values: DataFrame
    columns: list[str]
    size_bytes: int
    cells: int

    @cached_property
    def finals(self) -> DataFrame:
        """Per column and found text, the `token` that the cell ends with: that of its last type behind all others.

        Written once, since every column looks its own part up.
        """
        types = F.split("types", ">")
        last = {
            "pii_type": F.element_at(types, -1),
            "chain": F.array_join(F.slice(types, 1, F.size(types) - 1), ">"),
        }
        return written(
            self.values.withColumns(last)
            .join(self.entries.drop("occurrences", "token_no"), list(KEY))
            .select("column_ord", "types", "raw", "token", "occurrences"),
            "finals",
        )

    def replaced_counts(self) -> DataFrame:
        return self.entries.groupBy("pii_type").agg(F.sum("occurrences").cast("bigint").alias("replaced"))

    def token_map(self) -> DataFrame:
        """Token per type and text as the replacement met it: behind a chain, that text is the earlier token."""
        types = F.split("chain", ">")
        previous = self.entries.select(
            F.col("pii_type").alias("previous_type"), F.col("chain").alias("previous_chain"), "raw",
            F.col("token").alias("previous_token"),
        )
        keyed = self.entries.select(
            "pii_type", "chain", "raw", "token",
            F.element_at(types, -1).alias("previous_type"),
            F.array_join(F.slice(types, 1, F.size(types) - 1), ">").alias("previous_chain"),
        )
        first = keyed.where(F.col("chain") == "").select("pii_type", F.col("raw").alias("value"), "token")
        later = (
            keyed.where(F.col("chain") != "")
            .join(previous, ["previous_type", "previous_chain", "raw"])
            .select("pii_type", F.col("previous_token").alias("value"), "token")
        )
        return first.unionByName(later)


def _types(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: f["pii_type"]), ">")


def token_dictionary(cells: DataFrame, row_key: Sequence[str], known: DataFrame | None = None) -> TableDictionary:
    """Number the distinct values of each type by first appearance: column by column, then by row key.

    In a cell with several types, each later type sees the token of the one before it. That token stands for the
    types so far and the text of the cell, so these are the key, and no step has to wait for another.

    With entries that are `known` already, a value among them keeps its token, and new ones are numbered after the last
    of their type.
    """
    keys = list(row_key)
    position = F.col(f"`{keys[0]}`") if len(keys) == 1 else F.struct(*[F.col(f"`{k}`") for k in keys])
    # The rules run once, here: all later steps work with the distinct texts per column.
    values = written(
        cells.select(position.alias("row"), "column_ord", "column", "raw", _types(F.col("findings")).alias("types"))
        .groupBy("column_ord", "column", "types", "raw")
        .agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("occurrences")),
        "values",
    )
    types = F.split("types", ">")
    steps = F.transform(
        types,
        lambda t, i: F.struct(t.alias("pii_type"), F.array_join(F.slice(types, 1, i), ">").alias("chain")),
    )
    distinct = (
        values.select("column_ord", "row", "raw", "occurrences", F.inline(steps))
        .groupBy(*KEY)
        .agg(F.min(F.struct("column_ord", "row")).alias("first_seen"), F.sum("occurrences").alias("occurrences"))
    )
    first, taken = F.lit(0).cast("bigint"), None
    if known is not None:
        distinct = written(distinct, "distinct-values")
        taken = known.select(*KEY, "token_no", "token").join(distinct.select(*KEY, "occurrences"), list(KEY))
        # One row per type.
        last = {r["pii_type"]: r["last"] for r in known.groupBy("pii_type").agg(F.max("token_no").alias("last")).collect()}
        distinct = distinct.join(taken.select(*KEY), list(KEY), "left_anti")
        for pii_type, number in last.items():
            first = F.when(F.col("pii_type") == pii_type, F.lit(number)).otherwise(first)
    entries = numbered(sorted_once(distinct, ["pii_type"], ["first_seen"], "tokens"), ["pii_type"], "token_no")
    entries = entries.withColumn("token_no", F.col("token_no") + first)
    entries = entries.select(*KEY, "token_no", F.concat_ws("_", "pii_type", F.col("token_no").cast("string")).alias("token"), "occurrences")
    if taken is not None:
        entries = entries.unionByName(taken.select(*entries.columns))
    # One row per column.
    sizes = values.groupBy("column").agg(
        F.sum(F.octet_length("raw") + F.lit(ENTRY_BYTES)).alias("bytes"), F.sum("occurrences").alias("cells")
    ).collect()
    return TableDictionary(
        entries, values, [r["column"] for r in sizes], sum(r["bytes"] for r in sizes), sum(r["cells"] for r in sizes)
    )


def cell_tokens(cells: DataFrame, dictionary: TableDictionary) -> DataFrame:
    """The final token of each found cell.

    Only found cells take part. A text that very many of them hold is a skewed key on the side of the cells, which
    adaptive execution splits.
    """
    return cells.join(dictionary.finals.drop("occurrences"), list(VALUE))


@dataclass
class AnonymizedTable:
    table: DataFrame
    dictionary: TableDictionary


def anonymize_table(
    df: DataFrame,
    row_key: Sequence[str],
    mode: str | PrivacyMode,
    as_of: date | str | None = None,
    safe: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    order_columns: bool = False,
    dataset: str = "table",
    skip: Sequence[str] = (),
    known: DataFrame | None = None,
) -> AnonymizedTable:
    """Replace every found cell by its token. Columns with a finding become text, all others keep their type.

    The row key may hold findings too; `order_columns` adds copies of it (`_order_0`, ...) that stay as they are.
    `safe` marks count if they are of this `dataset` and mode. Nested and binary columns are left as they are, and
    so are those in `skip`. `known` are entries of an earlier dictionary whose tokens stay.

    With tokens of a checked size, each column looks its own up by broadcast and no row of the table moves.
    Otherwise the rows are numbered in a written copy, the tokens are matched by found cell, and come back by that
    number. Both ways give the same table, also where row keys are null or repeat.
    """
    mode = parse_mode(mode)
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    extra = [F.col(f"`{k}`").alias(f"_order_{i}") for i, k in enumerate(keys)] if order_columns else []
    # A mark belongs to a row, so with marks equal texts may differ in their types.
    marked = safe is not None and mode is PrivacyMode.STRICT
    if not marked:
        dictionary = token_dictionary(detect_cells(df, keys, mode, as_of, skip=skip), keys, known)
        touched = _touched(df, dictionary)
        if not touched:
            return AnonymizedTable(df.select("*", *extra), dictionary)
        if dictionary.size_bytes <= broadcast_bytes and len(touched) <= LOOK_UP_COLUMNS:
            return AnonymizedTable(_look_up(df, dictionary, touched, extra), dictionary)
    stored = written(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    cells = detect_cells(stored, [*keys, ROW], mode, as_of, skip=[*skip, ROW])
    if marked:
        cells = written(without_marked(cells, keys, safe, dataset, mode), "cells")
        dictionary = token_dictionary(cells, keys, known)
        touched = _touched(df, dictionary)
    found = cells.select(ROW, "column_ord", "raw", _types(F.col("findings")).alias("types"))
    return AnonymizedTable(_join_back(stored, cell_tokens(found, dictionary), df.columns, touched, extra), dictionary)


def _touched(df: DataFrame, dictionary: TableDictionary) -> list[tuple[int, str]]:
    return [(i, name) for i, name in detectable_columns(df) if name in dictionary.columns]


def _text(df: DataFrame, name: str) -> Column:
    return canonical_text(F.col(f"`{name}`"), df.schema[name].dataType)


def _join_back(
    stored: DataFrame, tokens: DataFrame, columns: Sequence[str], touched: list[tuple[int, str]], extra: list[Column]
) -> DataFrame:
    """The stored rows with their tokens, which are at most one per column."""
    by_row = tokens.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("column_ord", "token"))).alias("_tokens"))
    ords = {name: i for i, name in touched}
    replaced = [
        F.coalesce(F.try_element_at("_tokens", F.lit(ords[c])), _text(stored, c)).alias(c) if c in ords else F.col(f"`{c}`")
        for c in columns
    ]
    return stored.join(by_row, ROW, "left").select(*replaced, *extra)


def _look_up(
    df: DataFrame, dictionary: TableDictionary, touched: list[tuple[int, str]], extra: list[Column]
) -> DataFrame:
    """One broadcast of all tokens by column and text, reused by the look-up of every column."""
    ords = {name: i for i, name in touched}
    texts = {f"_text_{i}": _text(df, name) for name, i in ords.items()}
    keyed = df.select("*", *[text.alias(name) for name, text in texts.items()])
    keyed = keyed.withColumns({f"_key_{i}": F.concat(F.lit(f"{i}\n"), f"_text_{i}") for i in ords.values()})
    tokens = dictionary.finals.select(F.concat(F.col("column_ord").cast("string"), F.lit("\n"), "raw").alias("key"), "token")
    for i in ords.values():
        side = tokens.select(F.col("key").alias(f"_key_{i}"), F.col("token").alias(f"_token_{i}"))
        keyed = keyed.join(F.broadcast(side), f"_key_{i}", "left")
    return keyed.select(
        *[
            F.coalesce(f"_token_{ords[c]}", f"_text_{ords[c]}").alias(c) if c in ords else F.col(f"`{c}`")
            for c in df.columns
        ],
        *extra,
    )
