"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Rejected documents go, repeated lines are cut out, one document of each group of near duplicates stays (the one with the
smallest id), sources are brought to their target weights by repeating documents, and every document is encoded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.byte_bpe import round_trip
from hushframe.llm.jaccard_join import Similar, jaccard_components
from hushframe.llm.line_dedup import dedup_lines
from hushframe.llm.mixing import emit, mix
from hushframe.llm.quality_rules import apply_rules
from hushframe.storage import shared_folder, written

#: Near duplicates share at least 0.8 of their shingles of five words.
NEAR = Similar(above=80, below=100, shingle=5)
#: Up to so many ids of near duplicates are sent to every task; more meet the documents in a shuffle.
BROADCAST_IDS = 500_000


def _columns(docs: DataFrame, parent: str = "") -> list[Column]:
    """The columns of a table or of a struct of it, whatever characters their names hold."""
    return [F.col(f"{parent}`{c.replace('`', '``')}`").alias(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail them; repeated rows are judged alike."""
    return apply_rules(docs).filter("kept").select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines; `n_chars` follows the text. Texts that come out empty go."""
    made = dedup_lines(docs).filter(F.coalesce(F.col("text"), F.lit("")) != "")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return made.select(*[new[c].alias(c) if c in new else kept for c, kept in zip(docs.columns, _columns(docs, "row."), strict=True)])


def _single(docs: DataFrame) -> DataFrame:
    """(near_key, row): one row for each id and text, under a key of its own.

    That is the id where no other row has it. Rows with a null or repeated id have a hash of id and text for a key, and of
    those with the same id and text one stays. Only such rows move.
    """
    rows = docs.select(F.col("doc_id").alias("near_key"), F.struct(*_columns(docs)).alias("row"))
    odd = written(rows.groupBy("near_key").agg(F.count("*").alias("n")).filter("near_key is null or n > 1").select(F.col("near_key").alias("odd_id")), "odd-ids")
    many = odd.count()
    if not many:
        return rows
    side = F.broadcast(odd) if many <= BROADCAST_IDS else odd
    same = F.col("near_key").eqNullSafe(F.col("odd_id"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    repeated = rows.join(side, same, "left_semi").groupBy("near_key", F.sha2(text, 256).alias("text_hash")).agg(F.min("row").alias("row"))
    repeated = repeated.select(F.xxhash64("near_key", "text_hash").alias("near_key"), "row")
    return rows.join(side, same, "left_anti").unionByName(repeated)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Rows count by id and text: of equal ones one stays, also with null ids, and rows that have only their id in common are
    decided on their own (their place in the order of ids is a hash). Documents without words are in no group and stay.
    """
    single = _single(docs)
    groups = jaccard_components(single.select("near_key", "row.text"), doc_id="near_key", rule=NEAR)
    gone = written(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("near_key")).distinct(), "near-duplicates")
    few = gone.count() <= BROADCAST_IDS
    kept = single.join(F.broadcast(gone) if few else gone, "near_key", "left_anti")
    return kept.select(*_columns(docs, "row."))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for; empty texts weigh nothing and count as drawn."""
    return emit(mix(docs)).select(*_columns(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, their number, and digests of the ids and of what they decode to."""
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("source mixing", mixing),
    ("byte-level BPE", encoding),
]

#: Byte-level BPE can't be said in SQL: tests/llm compares the result with a step-by-step version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{number}")
    return docs
