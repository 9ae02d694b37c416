"""Bounded samples of labelled documents, to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import remainder, text_or_empty
from hushframe.storage import written

PARTS = 12


def held_out(doc_id: Column | str, divisor: int, fold: int) -> Column:
    return remainder(doc_id, divisor) == fold


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, divisor: int, fold: int, per_class: int, eligible: Column | None = None
) -> DataFrame:
    """A written table (text, label) of about `per_class` documents of each class, none of them held out.

    Ids are drawn from the labels by hash, so at most about 2 * per_class ids are broadcast to find the texts. A document
    with several labels counts as 1 if one of them is 1; null ids and null labels are left out.
    """
    marks = (
        labels.select(F.col("doc_id").alias("marked_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("marked_id").isNotNull() & F.col("label").isin(0, 1))
        .filter(~held_out("marked_id", divisor, fold))
        .groupBy("marked_id")
        .agg(F.max("label").alias("label"))
    )
    sizes = {row["label"]: row["n"] for row in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "marked_id"), F.lit(1_000_000))
    chosen = F.lit(False)
    for value, count in sizes.items():
        chosen = chosen | ((F.col("label") == value) & (draw < int(1_000_000 * min(1.0, per_class / count))))
    found = docs.join(F.broadcast(marks.filter(chosen)), F.col("doc_id") == F.col("marked_id"))
    found = found.select("doc_id", text_or_empty().alias("text"), "label")
    if eligible is not None:
        found = found.filter(eligible)
    # The order of the rows, and so the last digit of every sum over them, is the same in each run.
    return written(found.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "text").select("text", "label"), "labelled")
