"""Line dedup by winnowing over line hashes.

A document is the sequence of its lines that have a word. Of each `SPAN` neighbouring line hashes the smallest (the
rightmost of equal ones) is a fingerprint, and so is each line of at least `LONG` words. Whatever two documents share
for SPAN lines in a row, or in one long line, they share a fingerprint. Only fingerprints that occur again are looked
at further: their position brings the lines around it, the match is extended to both sides in runs of SPAN lines, and
every run that also starts earlier (smaller id, or earlier in the same document) is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import WORD, text_or_empty
from hushframe.llm.fingerprints import chosen_positions
from hushframe.storage import written

SPAN = 2
LONG = 8
#: Lines that occur more often are hot; up to so many of them, at most one for each HOT fingerprints, are broadcast.
HOT = 1_000
BROADCAST_HOT = 200_000


def _fingerprints(docs: DataFrame, span: int, long_words: int) -> DataFrame:
    """(doc_id, tid, hash, long, before, around) of each fingerprint.

    `around` holds the (at, h) of up to span - 1 lines before it, of itself and of span - 1 lines after it, `before` how
    many come before; `at` is the number of the line in the text.
    """
    all_lines = F.transform(
        F.split("text", "\n"),
        lambda line, at: F.struct(
            at.alias("at"), F.xxhash64(line).alias("h"),
            line.rlike(r"[^\x20\x09-\x0D]").alias("real"), (F.regexp_count(line, F.lit(WORD)) >= long_words).alias("long"),
        ),
    )
    rows = docs.select("doc_id", "tid", F.filter(all_lines, lambda line: line["real"]).alias("lines"))
    rows = rows.select("doc_id", "tid", "lines", F.transform("lines", lambda line: line["h"]).alias("hashes"))
    rows = rows.select("doc_id", "tid", "lines", chosen_positions(F.col("hashes"), span).alias("chosen"))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    long_lines = F.when(F.size("lines") > 0, F.filter(every, lambda k: F.get(F.col("lines"), k)["long"])).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "tid", "lines", F.explode(F.array_union("chosen", long_lines)).alias("k"))
    first = F.greatest(F.col("k") - (span - 1), F.lit(0))
    around = F.transform(F.slice("lines", first + 1, F.col("k") + span - first), lambda line: F.struct(line["at"].alias("at"), line["h"].alias("h")))
    here = F.get("lines", F.col("k"))
    return rows.select(
        "doc_id", "tid", here["h"].alias("hash"), here["long"].alias("long"), (F.col("k") - first).alias("before"), around.alias("around")
    )


def _runs(found: DataFrame, span: int) -> DataFrame:
    """(doc_id, tid, run, lines) of the runs of `span` lines through a fingerprint, and of long lines alone."""

    def run(start: Column, size: int) -> Column:
        part = F.slice("around", start + 1, F.lit(size))
        hashes = F.transform(part, lambda line: line["h"])
        name = F.struct(F.lit(size).alias("size"), F.xxhash64(hashes).alias("one"), F.xxhash64(F.lit("other"), hashes).alias("two"))
        return F.struct(name.alias("run"), F.transform(part, lambda line: line["at"]).alias("lines"))

    starts = F.sequence(F.lit(0), F.size("around") - span)
    wide = F.when(F.size("around") >= span, F.transform(starts, lambda s: run(s, span)))
    wide = F.filter(wide, lambda r: F.array_contains(r["lines"], F.get("around", F.col("before"))["at"]))
    alone = F.when(F.col("long"), F.array(run(F.col("before"), 1)))
    both = F.concat(F.coalesce(wide, F.array().cast("array<struct<run:struct<size:int,one:bigint,two:bigint>,lines:array<int>>>")),
                    F.coalesce(alone, F.array().cast("array<struct<run:struct<size:int,one:bigint,two:bigint>,lines:array<int>>>")))
    return found.select("doc_id", "tid", F.inline(both))


def _repeated(found: DataFrame, hot: int) -> DataFrame:
    """The fingerprints that occur again. Those of hot lines don't meet under one key: their hashes are broadcast."""
    counts = written(found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"), "line-hashes")
    frequent = counts.filter(F.col("n") > hot).select("hash")
    many = frequent.count()
    if not many:
        return found.join(counts.select("hash"), "hash", "left_semi")
    side = F.broadcast(frequent) if many <= BROADCAST_HOT else frequent
    rest = found.join(side, "hash", "left_anti").join(counts.filter(F.col("n") <= hot).select("hash"), "hash", "left_semi")
    return found.join(side, "hash", "left_semi").unionByName(rest)


def repeated_lines(docs: DataFrame, span: int = SPAN, long_words: int = LONG) -> DataFrame:
    """(doc_id, tid, removed): the numbers of the lines to delete, for (doc_id, tid, text) rows; unchanged ones are absent.

    Whatever is not the first place of its run is a repeat, so a run that a third of all documents have is never the key
    of a join: it is summed up to one row before it moves.
    """
    found = written(_fingerprints(docs, span, long_words), "line-fingerprints")
    runs = written(_runs(_repeated(found, HOT), span), "line-runs")
    placed = runs.withColumns({"start": F.get("lines", F.lit(0)), "size": F.col("run.size")})
    firsts = placed.groupBy("run").agg(F.min(F.struct("doc_id", "tid", "start", "size")).alias("first"))
    firsts = firsts.select(*[F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "tid", "start", "size")])
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in ("doc_id", "tid", "start", "size")]
    later = placed.join(firsts, same, "left_anti")
    lines = later.select("doc_id", "tid", F.explode("lines").alias("line")).distinct()
    return lines.groupBy("doc_id", "tid").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, long_words: int = LONG) -> DataFrame:
    """(row, text, n_lines, removed) of every row: its columns, the text without repeated runs, its lines with a word, and the
    numbers of the deleted lines.

    A null or empty text has no lines and stays as it is. Null ids come before all others. Rows with the same id and text
    are one document and stay alike; texts with the same id are ordered by a hash. Blank lines are neither compared nor
    deleted.
    """
    body = text_or_empty(text)
    keyed = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("tid"), body.alias("text"))
    changes = written(repeated_lines(keyed.select("doc_id", "tid", "text"), span, long_words), "line-changes")
    side = changes.select(F.col("doc_id").alias("c_id"), F.col("tid").alias("c_tid"), "removed")
    # Texts without a word lose nothing and take no part in the join, where equal ones would be one hot key.
    worded = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    joined = keyed.filter(worded).join(side, keyed["doc_id"].eqNullSafe(F.col("c_id")) & (keyed["tid"] == F.col("c_tid")), "left").drop("c_id", "c_tid")
    joined = joined.unionByName(keyed.filter(~worded).withColumn("removed", F.lit(None).cast("array<int>")))
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda line, at: ~F.array_contains("removed", at)), "\n")
    real = F.size(F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    none = F.array().cast("array<int>")
    changed = F.when(F.col("removed").isNull(), F.col(f"row.{text}")).otherwise(kept)
    return joined.select("row", changed.alias("text"), real.alias("n_lines"), F.coalesce("removed", none).alias("removed"))
