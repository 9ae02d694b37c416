"""Ranks and running totals over a global order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.storage import written

POSITION = "_position"
PIECE = "_piece"
FIRST = "_first_position"
EARLIER = "_earlier_"


def _piece() -> Column:
    """The upper part of a generated id: the number of the partition of the sort."""
    return F.shiftright(F.col(POSITION), 33)


def sorted_once(df: DataFrame, group: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Sort by range partitions and write the result with its positions, which then are data."""
    return written(df.orderBy(*group, *order).withColumn(POSITION, F.monotonically_increasing_id()), label)


def _with_offsets(flat: DataFrame, group: Sequence[str], amounts: dict[str, Column]) -> DataFrame:
    """Join each row with the totals of its group in earlier pieces, one `_earlier_<name>` per amount.

    A sort keeps each group in consecutive pieces, so there are at most as many rows to broadcast as partitions of
    the sort plus groups. The callers group by type, by column or by the few largest keys.
    """
    pieces = flat.groupBy(*group, _piece().alias(PIECE)).agg(
        F.min(POSITION).alias(FIRST), *[F.sum(amount).alias(EARLIER + name) for name, amount in amounts.items()]
    )
    before = Window.partitionBy(*group).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumns(
        {EARLIER + name: F.coalesce(F.sum(EARLIER + name).over(before), F.lit(0)) for name in amounts}
    )
    return flat.withColumn(PIECE, _piece()).join(F.broadcast(offsets), [*group, PIECE])


def numbered(flat: DataFrame, group: Sequence[str], number: str) -> DataFrame:
    """Number the rows of a `sorted_once` table from 1 within each group."""
    return (
        _with_offsets(flat, group, {"rows": F.lit(1)})
        .withColumn(number, F.col(POSITION) - F.col(FIRST) + F.col(EARLIER + "rows") + 1)
        .drop(POSITION, PIECE, FIRST, EARLIER + "rows")
    )


def with_totals(flat: DataFrame, group: Sequence[str], amounts: dict[str, str]) -> DataFrame:
    """Add running totals to a `sorted_once` table: per new name, the sum of a column over the earlier rows."""
    within = Window.partitionBy(*group, PIECE).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, -1)
    totals = {
        name: F.coalesce(F.sum(amount).over(within), F.lit(0)) + F.col(EARLIER + name) for name, amount in amounts.items()
    }
    return (
        _with_offsets(flat, group, {name: F.col(amount) for name, amount in amounts.items()})
        .withColumns(totals)
        .drop(POSITION, PIECE, FIRST, *[EARLIER + name for name in amounts])
    )


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], amount: str, name: str) -> DataFrame:
    """Sort, and add the total of `amount` over the earlier rows of the group."""
    return with_totals(sorted_once(df, group, order, "running-total"), group, {name: amount})
