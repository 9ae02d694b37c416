"""Document fingerprints by winnowing, with DataFrame functions only.

A document is a sequence of tokens: runs of non-space characters. Each run of `GRAM` tokens has a hash; of each `SPAN`
neighbouring hashes the smallest is chosen, among equal ones the rightmost, and kept with its position. Two texts that
share GRAM + SPAN - 1 tokens in a row share a fingerprint. Grams are of words rather than characters, since a
row-local expression per character costs more than reading the table; README.md has the figures.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import text_or_empty, words_of

GRAM = 5
SPAN = 6
#: About so many bytes of documents are put in order by one task, in at most so many ranges of ids.
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 50_000
#: Estimates from here on only say that the size of a table is unknown.
UNKNOWN_BYTES = 1 << 58


def gram_hashes(token_hashes: Column, gram: int = GRAM) -> Column:
    """One hash per run of `gram` tokens; a shorter text is one run, an empty one has none."""
    n = F.size(token_hashes)
    runs = F.transform(
        F.sequence(F.lit(0), n - gram), lambda i: F.xxhash64(*[F.get(token_hashes, i + k) for k in range(gram)])
    )
    none = F.array().cast("array<bigint>")
    return F.when(n >= gram, runs).when(n > 0, F.array(F.xxhash64(token_hashes))).otherwise(none)


def chosen_positions(hashes: Column, span: int = SPAN) -> Column:
    """Positions of the hashes that are the rightmost minimum of some `span` neighbours (or of all, if fewer).

    A hash is chosen if enough neighbours to the left are not smaller and enough to the right are larger. `hashes`
    must be a plain column.
    """

    def reach(h: Column, i: Column, step: int) -> Column:
        """How many neighbours in a row, at most span - 1, leave `h` the rightmost minimum."""
        out = F.lit(span - 1)
        for k in range(span - 1, 0, -1):
            other = F.get(hashes, i + step * k)
            holds = other >= h if step < 0 else other > h
            out = F.when(F.coalesce(holds, F.lit(False)), out).otherwise(k - 1)
        return out

    need = F.least(F.lit(span), F.size(hashes)) - 1
    every = F.transform(hashes, lambda h, i: F.when(reach(h, i, -1) + reach(h, i, 1) >= need, i))
    return F.array_compact(every)


def with_fingerprints(rows: DataFrame, texts: Sequence[str], gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """Add `<text>_hashes` and `<text>_positions` (arrays of long and int) for each text column.

    A null or empty text has empty arrays. Equal texts have equal arrays. The hash at position p is that of the
    tokens p to p + gram - 1.
    """
    plain = rows.columns
    rows = rows.select(
        *plain,
        *[F.transform(words_of(text_or_empty(t)), lambda word: F.xxhash64(word)).alias(f"{t}_tokens") for t in texts],
    )
    rows = rows.select(*plain, *[gram_hashes(F.col(f"{t}_tokens"), gram).alias(f"{t}_grams") for t in texts])
    rows = rows.select(
        *plain, *[f"{t}_grams" for t in texts], *[chosen_positions(F.col(f"{t}_grams"), span).alias(f"{t}_positions") for t in texts]
    )
    at = lambda t: F.transform(f"{t}_positions", lambda p: F.get(F.col(f"{t}_grams"), p))
    kept = [at(t).alias(f"{t}_hashes") for t in texts]
    return rows.select(*plain, *[f"{t}_positions" for t in texts], *kept)


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct hashes over all distinct hashes; two empty fingerprints are alike."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def digest(hashes: Column, positions: Column) -> Column:
    """A fingerprint as one short string."""
    join = lambda values: F.array_join(values.cast("array<string>"), ",")
    return F.sha2(F.concat(join(hashes), F.lit(";"), join(positions)), 256)


def _bucket_starts(ids: DataFrame, buckets: int) -> list[int | None]:
    """The first id of each of about `buckets` ranges of ids, nulls first; one value per range reaches the driver."""
    row = ids.agg(
        F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min("doc_id").alias("first"),
        F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)] or [0.5], 10_000).alias("cuts"),
    ).first()
    if row["first"] is None:
        return [None]
    cuts = sorted({row["first"], *(row["cuts"] if buckets > 1 else ())})
    # Cuts come from a sketch: the smallest id at or above each of them is exact.
    firsts = ids.filter("doc_id is not null").groupBy(_range_of(F.col("doc_id"), cuts).alias("r")).agg(F.min("doc_id").alias("first"))
    starts = sorted(r["first"] for r in firsts.collect())
    return [None, *starts] if row["nulls"] else starts


def _longs(values: list[int]) -> Column:
    """A constant array; as one text, since the plan would hold an expression for each value otherwise."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _range_of(doc_id: Column, starts: list[int]) -> Column:
    """The number of the range that an id is in. Two short lists are looked through instead of one long one."""
    wide = max(1, int(len(starts) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda start: start <= doc_id))
    if len(starts) <= 64:
        return below(_longs(starts)) - 1
    block = F.greatest(below(_longs(starts[::wide])) - 1, F.lit(0))
    return block * wide + below(F.slice(_longs(starts), block * wide + 1, wide)) - 1


def with_next(rows: DataFrame, columns: Sequence[str], buckets: int, prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add `next_<column>` of the row that follows in the order of (doc_id, text); the first follows the last.

    Rows are shuffled once, by ranges of ids; the first rows of a range also go to the range before it, as guests.
    `prepare` adds columns to the rows of a range before they look at each other. Null ids come first. Rows with equal
    ids and texts are interchangeable.
    """
    starts = _bucket_starts(rows.select("doc_id"), buckets)
    known = [s for s in starts if s is not None]
    shift = len(starts) - len(known)
    bucket, first = F.lit(0), F.lit(True)
    if known:
        doc_id = F.col("doc_id")
        bucket = F.when(doc_id.isNull(), F.lit(0)).otherwise(_range_of(doc_id, known) + shift)
        first = F.coalesce(F.get(_longs(known), bucket - shift) == doc_id, F.lit(True))
    place = lambda at, guest: F.struct(at.cast("int").alias("bucket"), F.lit(guest).alias("guest"))
    own, before = place(bucket, False), place(F.pmod(bucket - 1, F.lit(len(starts))), True)
    dealt = rows.select(*rows.columns, F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select(*rows.columns, "to.bucket", "to.guest").repartition(max(len(starts), 2), "bucket")
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", "text")
    following = prepare(dealt).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return following.filter("not guest").drop("bucket", "guest")


def buckets_for(docs: DataFrame) -> int:
    """So many ranges that one of them holds about `BUCKET_BYTES` of the table's files."""
    estimate = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate >= UNKNOWN_BYTES:
        return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(-(-estimate // BUCKET_BYTES), MOST_BUCKETS))


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next document's are.

    The edited text has its last quarter replaced by the beginning of the next document, in the order of ids. Returns
    doc_id, n_chars, edited_sha256, hashes, positions, edited_hashes, edited_positions, near_edited, near_next. A null
    or empty text is empty, its fingerprint too; two empty fingerprints are alike (1.0). Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    own = lambda placed: with_fingerprints(placed, ["text"])
    placed = with_next(rows, ["text", "text_hashes"], buckets_for(docs), own)
    quarter = F.floor(F.length("text") / 4).cast("int")
    start = F.substring(F.col("text"), F.lit(1), F.length("text") - quarter)
    edited = placed.withColumn("edited", F.concat(start, F.substring(F.col("next_text"), F.lit(1), quarter)))
    return with_fingerprints(edited.drop("next_text"), ["edited"]).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("text_hashes").alias("hashes"), F.col("text_positions").alias("positions"), "edited_hashes", "edited_positions",
        likeness(F.col("text_hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("text_hashes"), F.col("next_text_hashes")).alias("near_next"),
    )
