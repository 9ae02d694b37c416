"""Profiles of texts: characters, lines, words and keywords."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.text import let, line_count, word_count

# Czech words without a meaning of their own, shortest keyword and keywords per text.
STOPWORDS = (
    "a", "aby", "ale", "ani", "by", "co", "do", "i", "jako", "je", "jsou", "k", "na", "ne", "nebo", "se", "si", "s",
    "to", "u", "v", "ve", "z", "za", "ze",
)
KEYWORD_CHARS = 3
KEYWORDS = 15

# More than the words of any one text, which has less than 2^31 bytes.
TEXT_SPAN = 10**10


def _terms(text: Column, stopwords: Sequence[str]) -> Column:
    """The lower-case words that may be keywords, in order, as (term, position)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}_]{{{KEYWORD_CHARS},}}"), F.lit(0))
    terms = F.transform(words, lambda word, i: F.struct(word.alias("term"), i.alias("position")))
    long_stopwords = [w for w in stopwords if len(w) >= KEYWORD_CHARS]
    return F.filter(terms, lambda t: ~t["term"].isin(long_stopwords)) if long_stopwords else terms


def text_counts(df: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        *key,
        F.length(value).cast("bigint").alias("char_count"),
        line_count(value).alias("line_count"),
        word_count(F.lower(value)).alias("word_count"),
    )


def keywords_column(text: Column, limit: int = KEYWORDS, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """The most frequent words of one text as array<struct<term,count>>; ties go by first occurrence.

    The words are sorted inside the row: equal words then stand together and the next start gives the count.
    """

    def count_terms(terms: Column) -> Column:
        def is_start(entry: Column, i: Column) -> Column:
            return (i == 0) | (F.get(terms, i - 1)["term"] != entry["term"])

        at = F.transform(
            terms, lambda entry, i: F.struct(entry["term"].alias("term"), entry["position"].alias("position"), i.alias("at"),
                                             is_start(entry, i).alias("start"))
        )
        starts = F.filter(at, lambda entry: entry["start"])
        return let(
            starts,
            lambda first: F.transform(
                first,
                lambda entry, i: F.struct(
                    (entry["at"] - F.coalesce(F.get(first, i + 1)["at"], F.size(terms))).alias("minus_count"),
                    entry["position"].alias("position"),
                    entry["term"].alias("term"),
                ),
            ),
        )

    ranked = F.slice(F.sort_array(let(F.sort_array(_terms(text, stopwords)), count_terms)), 1, limit)
    return F.transform(
        ranked, lambda e: F.struct(e["term"].alias("term"), (-e["minus_count"]).cast("bigint").alias("count"))
    )


def keywords_by_text(
    df: DataFrame, key: Sequence[str], text: str, limit: int = KEYWORDS, stopwords: Sequence[str] = STOPWORDS
) -> DataFrame:
    """Keywords of every text, one row each; computed inside the row, without a shuffle."""
    return df.select(*key, F.posexplode(keywords_column(F.col(text), limit, stopwords))).select(
        *key, (F.col("pos") + 1).alias("rank"), "col.term", "col.count"
    )


def keywords_by_group(
    df: DataFrame,
    key: Sequence[str],
    text: str,
    group: Sequence[str] = (),
    limit: int = KEYWORDS,
    stopwords: Sequence[str] = STOPWORDS,
) -> DataFrame:
    """Keywords of each group of texts (without `group`: of the corpus); ties go by text key and position.

    Words are counted before the shuffle, and the ranking keeps `limit` words per task before the next one, so a
    group that holds most of the corpus does not gather in one task.
    """
    key = list(key)
    whole_numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if len(key) == 1 and isinstance(df.schema[key[0]].dataType, whole_numbers):
        # One number for text and position keeps the aggregation on its fast path.
        base = (F.col(key[0]).cast("decimal(19,0)") * F.lit(Decimal(TEXT_SPAN))).cast("decimal(38,0)")
        seen = F.col("_base") + F.col("position").cast("decimal(10,0)")
    else:
        base = F.struct(*key)
        seen = F.struct("_base", "position")
    words = df.select(*group, base.alias("_base"), F.inline(_terms(F.col(text), stopwords)))
    totals = words.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("count"), F.min(seen).alias("first_seen"))
    order = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return (
        totals.withColumn("rank", F.row_number().over(order.orderBy(F.desc("count"), "first_seen")))
        .where(F.col("rank") <= limit)
        .select(*group, "rank", "term", "count")
    )
