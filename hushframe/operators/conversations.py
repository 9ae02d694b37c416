"""Stored conversations: order of turns, appended turns and normalised content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.text import canonical_text, is_atomic, strip
from hushframe.operators.ordered import sorted_once, with_totals
from hushframe.storage import written

# A conversation with more rows than this is too long for one task.
LONG_ROWS = 100_000
# Up to so many long conversations, and long groups of turns, are broadcast.
BROADCAST_LONG = 100_000
CONV = "_conversation"


def newest_first(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", long_rows: int = LONG_ROWS
) -> DataFrame:
    """Add `turn_group` and `position`: groups start at each user message, the newest group comes first.

    Messages of the same turn are ordered by their role, then by their other columns. Usual conversations are ordered
    by a window each; long ones are sorted across tasks and positioned by running totals, with the same result.
    Messages without an id are one conversation.
    """
    order = [turn, role, *(f.name for f in messages.schema.fields if f.name not in (conv, turn, role) and is_atomic(f.dataType))]
    if messages.count() <= long_rows:
        return _by_window(messages, conv, order, role)
    # A text that no null has in common with an id: messages without an id are one conversation, maybe a long one.
    keyed = messages.withColumn(CONV, F.when(F.col(conv).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv).cast("string"))))
    long_ones = written(keyed.groupBy(CONV).count().where(F.col("count") > long_rows).select(CONV), "long-conversations")
    if long_ones.isEmpty():
        return _by_window(messages, conv, order, role)
    # At most one for each `long_rows` messages.
    side = F.broadcast(long_ones) if long_ones.count() <= BROADCAST_LONG else long_ones
    result = [*messages.columns, "turn_group", "position"]
    usual = keyed.join(side, CONV, "left_anti")
    long_ = _by_totals(keyed.join(side, CONV, "left_semi"), order, role, long_rows)
    return _by_window(usual, conv, order, role).select(*result).unionByName(long_.select(*result))


def _starts_group(role: str) -> Column:
    return F.when(F.col(role) == "user", 1).otherwise(0).cast("bigint")


def _by_window(messages: DataFrame, conv: str, order: list[str], role: str) -> DataFrame:
    by_turn = Window.partitionBy(conv).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = messages.withColumn("turn_group", F.sum(_starts_group(role)).over(by_turn))
    shown = Window.partitionBy(conv).orderBy(F.desc("turn_group"), *order)
    return grouped.withColumn("position", F.row_number().over(shown).cast("bigint"))


def _by_totals(messages: DataFrame, order: list[str], role: str, long_rows: int) -> DataFrame:
    """Positions from running totals. Long groups, a bounded number, come to their messages by broadcast, so that a
    conversation of one group is not one key of a shuffle."""
    flat = sorted_once(
        messages.withColumns({"_one": F.lit(1).cast("bigint"), "_start": _starts_group(role)}), [CONV], order, "turns"
    )
    at = with_totals(flat, [CONV], {"_index": "_one", "_starts": "_start"}).withColumn(
        "turn_group", F.col("_starts") + F.col("_start")
    )
    keys = [CONV, "turn_group"]
    groups = written(
        at.groupBy(*keys).agg(F.min("_index").alias("_first"), F.max("_index").alias("_last"), F.count("*").alias("_size")), "turn-groups"
    )
    ends = groups.groupBy(CONV).agg(F.max("_last").alias("_end"))
    bounds = groups.join(ends, CONV)
    hot = bounds.where(F.col("_size") > long_rows)
    side = F.broadcast(hot) if hot.count() <= BROADCAST_LONG else hot
    placed = at.join(side, keys).unionByName(at.join(side, keys, "left_anti").join(bounds.where(F.col("_size") <= long_rows), keys))
    # Later groups come before, then the messages of the own group up to this one.
    return placed.withColumn("position", F.col("_end") - F.col("_last") + F.col("_index") - F.col("_first") + 1)


def append_pair(
    messages: DataFrame, replies: DataFrame, conv: str = "conv_id", turn: str = "turn"
) -> DataFrame:
    """Append a stripped prompt and its reply to conversations.

    `replies` holds `conv`, `prompt` and `reply`, with one row per conversation.

    `messages` has the columns `conv`, `turn`, `role` and `text`. A conversation without messages starts at turn 0.
    """
    last = messages.groupBy(conv).agg(F.max(turn).alias("_last"))
    pair = F.array(
        F.struct(F.lit(1).alias("_step"), F.lit("user").alias("role"), strip(F.col("prompt")).alias("text")),
        F.struct(F.lit(2).alias("_step"), F.lit("assistant").alias("role"), F.col("reply").alias("text")),
    )
    added = (
        replies.join(last, conv, "left")
        .select(conv, F.coalesce("_last", F.lit(-1)).alias("_last"), F.inline(pair))
        .select(conv, (F.col("_last") + F.col("_step")).cast(messages.schema[turn].dataType).alias(turn), "role", "text")
    )
    return messages.select(conv, turn, "role", "text").unionByName(added)


def _part_text(part: Column) -> Column:
    """The text of a part that is no object: `True`, `None` and `1.0` are spelled so; lists stay JSON."""
    kind = F.schema_of_variant(part)
    # A whole number is a long, or a decimal if it is too large for one.
    number = kind.rlike(r"^(DOUBLE|FLOAT|DECIMAL\(([0-9]|1[0-8]),|DECIMAL\([0-9]+,[1-9])")
    return (
        F.when(F.is_variant_null(part), "None")
        .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(part, "$", "string")))
        .when(number, canonical_text(F.try_variant_get(part, "$", "double"), T.DoubleType()))
        .otherwise(F.coalesce(F.try_variant_get(part, "$", "string"), F.to_json(part)))
    )


def normalise_content(content: Column) -> Column:
    """The text of a stored content: a JSON list gives its parts line by line, anything else stays as it is.

    A part gives its `text` field if it has one, be it null, and else its own text; an object without it is JSON.
    """
    parts = F.try_parse_json(content)
    is_list = F.substring(F.ltrim(content), 1, 1) == "["
    items = F.try_variant_get(parts, "$", "array<variant>")
    texts = F.transform(items, lambda item: _part_text(F.coalesce(F.try_variant_get(item, "$.text", "variant"), item)))
    return F.when(is_list & items.isNotNull(), strip(F.array_join(texts, "\n", "None"))).otherwise(content)
