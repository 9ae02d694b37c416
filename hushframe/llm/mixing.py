"""Mix sources to target weights: repeat each document by the rate of its source.

Sizes are summed per source (a hot source is pre-aggregated in every task), targets come from the weights, and a
document is emitted floor(rate) times plus once more with the probability of the fraction, drawn from its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import WORD, text_or_empty
from hushframe.operators.ordered import numbered, sorted_once
from hushframe.storage import written

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times.
MOST = 3
SEED = "mix"
#: Up to so many sources, with names of so many bytes in all, the rates are broadcast; beyond, the join is salted.
BROADCAST_SOURCES = 50_000
BROADCAST_BYTES = 8 << 20
SALTS = 32


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that only depends on the id and the seed."""
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, rate, for (source, size) rows.

    The total is shared by weight. A source whose share exceeds `most` times its size stops there, and what is
    left is shared again among the others until no share is too large. Only a few sums reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Code point order is byte order in UTF-8; the flag puts the null source last.
    ranked = numbered(
        sorted_once(totals.withColumn("last", F.col("source").isNull()), (), ("last", "source"), "mix-sources"), (), "position"
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    shares = written(ranked.select("source", "source_size", weight.cast("long").alias("weight")), "mix-weights")
    cap = most * F.col("source_size")
    total, level, capped = 0, None, -1
    while True:
        # Whole numbers decide which sources are full, so reruns and other engines agree.
        full = F.lit(False) if level is None else cap * level[1] <= F.col("weight") * level[0]
        row = shares.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).cast("decimal(38,0)").alias("total"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).cast("decimal(38,0)").alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).cast("decimal(38,0)").alias("open"),
            F.count_if(full).alias("capped"),
        ).first()
        total, held, open_weight = int(row["total"]), int(row["held"]), int(row["open"])
        if row["capped"] == capped or open_weight == 0:
            break
        capped, level = row["capped"], (F.lit(total - held).cast("decimal(20,0)"), F.lit(open_weight).cast("decimal(12,0)"))
    left, parts = (float(total - held), float(open_weight)) if open_weight else (0.0, 1.0)
    full = F.lit(True) if not open_weight else cap * level[1] <= F.col("weight") * level[0]
    target = F.when(full, cap.cast("double")).otherwise(F.lit(left) * F.col("weight") / F.lit(parts))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return shares.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def _with_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Join the rates on the source, null included, without a hot key."""
    size = rates.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("bytes")).first()
    rates = rates.withColumnRenamed("source", "rate_source")
    if size["n"] <= BROADCAST_SOURCES and size["bytes"] <= BROADCAST_BYTES:
        return docs.join(F.broadcast(rates), docs["mix_source"].eqNullSafe(rates["rate_source"])).drop("rate_source")
    salted = docs.withColumn("salt", F.pmod(F.xxhash64("mix_key"), F.lit(SALTS)))
    spread = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = salted["mix_source"].eqNullSafe(spread["rate_source"]) & (salted["salt"] == spread["rate_salt"])
    return salted.join(spread, same).drop("rate_source", "rate_salt", "salt")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """One row per document: row (all its columns), size, source_size, target, rate, copies.

    A null or empty text has size 0; it may be copied, and takes no words. A null source is a source of its own. A source
    without words has target and rate 0. Rows with equal ids draw the same number, so repeated rows are
    repeated alike. An empty table gives an empty result.
    """
    sized = docs.select(
        F.struct("*").alias("row"), F.col(source).cast("string").alias("mix_source"), F.col(doc_id).alias("mix_key"),
        word_count(text_or_empty(text)).alias("size"),
    )
    rates = source_rates(sized.select(F.col("mix_source").alias("source"), "size"))
    joined = _with_rates(sized, rates)
    whole = F.floor("rate")
    copies = whole + (uniform(F.col("mix_key"), seed) < F.col("rate") - whole).cast("long")
    return joined.select("row", "size", "source_size", "target", "rate", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns that they came with."""
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return mixed.filter("copies > 0").select("row", F.explode(copies).alias("copy")).select("row.*")
