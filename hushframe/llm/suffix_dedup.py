"""Suffix dedup: remove every byte that lies in a string of `LENGTH` bytes which also starts earlier.

External induced sorting over sampled suffixes. A suffix array of all positions holds more than ten bytes for each byte
of text, so only a sample of the suffixes is sorted, and the rest is induced from it:

1. Sample. Among the `LENGTH - GRAM + 1` grams of each string of LENGTH bytes, the one with the smallest hash is an
   anchor. Equal strings have their anchor at the same place, so a repeated string shows as a repeated anchor.
2. Sort and name. Tuples of (gram, context, place) go through Spark's external sort, which spills to disk and is dealt
   over all tasks. The context is all that a string through the anchor can reach; tuples with equal contexts have the same
   name, and all but the first of a name are repeats over their whole reach. No text is moved for that.
3. Induce. Where one gram has several contexts, the first of each is sorted once more by its suffix, which gives the
   common prefix of neighbours. One step to the left at a time, the strings that start before the anchor are
   induced: their class is the class of the suffix one byte further on and the byte itself, while the prefix that must be
   common shrinks by one. The first of each class is the earliest string, the others are repeats.

Steps 2 and 3 read sorted streams, so a task holds a batch and not a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.byte_bpe import slices
from hushframe.llm.common import RangeHashes, mixed, text_bytes, text_or_empty
from hushframe.storage import written

LENGTH = 100
GRAM = 32
#: The farthest that a string of LENGTH bytes reaches before or after its anchor.
REACH = LENGTH - GRAM
#: Contexts that are compared at once, and the most that one gram may have before its strings are grouped instead.
CHUNK = 20_000
HOT = 50_000


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The smallest or largest of each `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = best(values[:-step], values[step:])
        have += step
    return values


def anchors(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in `flat`, gram hash) of the anchors of each text."""
    if len(flat) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(flat) - GRAM + 1)
    grams = RangeHashes(flat)(at, at + GRAM)
    least = _sliding(grams, REACH + 1, np.minimum)
    # Strings that reach into the next text do not count.
    for edge in np.unique(offsets[1:-1]):
        least[max(0, edge - LENGTH + 1) : edge] = 0
    least = np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)])
    place = np.flatnonzero(_sliding(least, REACH + 1, np.maximum) == grams)
    return np.searchsorted(offsets, place, "right") - 1, place, grams[place]


_PLACE = "id long, tid long"


def _named(docs: DataFrame) -> DataFrame:
    """(gram, name, id, tid, start, at, end, repeat): anchors with the range of their context in the text.

    Of equal contexts in a slice only the first travels by its gram; the others are repeats already, so that a passage
    of a third of all documents does not make a hot key. Of repeated rows in a slice only one is read: their places are
    the same, and a place does not repeat itself.
    """
    names = ["gram", "name", "id", "tid", "start", "at", "end", "repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                keys = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tid")])
                single = np.unique(keys, axis=0, return_index=True)[1]
                if len(single) < len(keys):
                    part = part.take(pa.array(np.sort(single)))
                flat, offsets = text_bytes(part.column("text"))
                doc, place, gram = anchors(flat, offsets)
                start = np.maximum(place - REACH, offsets[doc])
                end = np.minimum(place + LENGTH, offsets[doc + 1])
                with np.errstate(over="ignore"):
                    name = RangeHashes(flat)(start, end) + mixed((place - start).astype(np.uint64))
                ids, tids = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("id", "tid"))
                order = np.lexsort((place, tids, ids, name, gram))
                gram, name, ids, tids, doc, start, place, end = (x[order] for x in (gram, name, ids, tids, doc, start, place, end))
                repeat = np.zeros(len(gram), bool)
                repeat[1:] = (gram[1:] == gram[:-1]) & (name[1:] == name[:-1])
                key = np.where(repeat, mixed(gram + np.arange(len(gram), dtype=np.uint64)), gram)
                base = offsets[doc]
                columns = [key.view(np.int64), name.view(np.int64), ids, tids, start - base, place - base, end - base]
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], pa.array(repeat)], names)

    return docs.select("id", "tid", "text").mapInArrow(
        run, f"gram long, name long, {_PLACE}, start long, at long, end long, repeat boolean"
    )


def _first_and_rest(named: DataFrame) -> DataFrame:
    """(gram, id, tid, start, at, end, repeat) of repeated contexts, and of the first ones where a gram has several.

    The same place comes from several slices if a row is repeated; only its first one counts.
    """
    ordered = named.repartition("gram").sortWithinPartitions("repeat", "gram", "name", "id", "tid", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, name, *place = (batch.column(c).to_numpy() for c in ("gram", "name", "id", "tid", "at"))
            done = batch.column("repeat").to_numpy(zero_copy_only=False)
            new_gram, new_name = np.ones(len(gram), bool), np.ones(len(gram), bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_name[1:] = new_gram[1:] | (name[1:] != name[:-1])
            same = np.zeros(len(gram), bool)
            same[1:] = ~new_name[1:] & np.logical_and.reduce([x[1:] == x[:-1] for x in place])
            if last is not None and not done[0]:
                new_gram[0] = gram[0] != last[0]
                new_name[0] = new_gram[0] or name[0] != last[1]
                same[0] = not new_name[0] and [x[0] for x in place] == last[2]
            repeat = done | ~new_name
            # A first context is compared if its gram has another one, maybe in a later batch.
            heads = np.flatnonzero(~repeat)
            several = ~new_gram[heads]
            compare = several.copy()
            compare[:-1] |= several[1:]
            if len(heads):
                if waiting is not None and several[0]:
                    yield waiting
                waiting = None if several[-1] or compare[-1] else batch.slice(int(heads[-1]), 1).drop_columns(["name"])
            keep = done | (repeat & ~same)
            keep[heads[compare]] = True
            marked = batch.set_column(batch.schema.get_field_index("repeat"), "repeat", pa.array(repeat)).drop_columns(["name"])
            yield marked.filter(pa.array(keep))
            last = None if done[-1] else (gram[-1], name[-1], [x[-1] for x in place])

    return ordered.mapInArrow(run, f"gram long, {_PLACE}, start long, at long, end long, repeat boolean")


def _contexts(moved: DataFrame, firsts: DataFrame) -> DataFrame:
    """(gram, id, tid, at, suffix, before) of the contexts to compare: what follows an anchor, and what precedes it, backwards."""
    lists = firsts.groupBy("id", "tid").agg(F.collect_list(F.struct("gram", "start", "at", "end")).alias("parts"))
    # Repeated rows have the same places: one of them is enough.
    single = moved.dropDuplicates(["id", "tid"])
    joined = single.join(lists, ["id", "tid"], "left").select("id", "tid", "text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, text, parts in zip(*(batch.column(c).to_pylist() for c in ("id", "tid", "text", "parts")), strict=True):
                if parts:
                    data = text.encode()
                    rows += [(p["gram"], i, t, p["at"], data[p["at"] : p["end"]], data[p["start"] : p["at"]][::-1]) for p in parts]
                if len(rows) >= CHUNK:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return joined.mapInArrow(run, f"gram long, {_PLACE}, at long, suffix binary, before binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    names = ("gram", "id", "tid", "at", "suffix", "before")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width), lengths


def induced_repeats(group: np.ndarray, suffixes: list[bytes], befores: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per anchor, the nearest and the farthest start (in bytes before the anchor) of a string that also starts earlier.

    Rows are sorted by (group, suffix). `rank` orders them by place. Farthest -1: no such string.
    """
    n = len(group)
    after, after_length = _matrix(suffixes, LENGTH)
    before, before_length = _matrix(befores, REACH)
    # The prefix that each suffix has in common with the one before it in the order.
    common = np.zeros(n, np.int64)
    differ = after[1:] != after[:-1]
    common[1:] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    common[1:] = np.minimum(common[1:], np.minimum(after_length[1:], after_length[:-1]))
    common[1:][group[1:] != group[:-1]] = -1
    nearest, farthest = np.full(n, LENGTH), np.full(n, -1)
    live, left = np.arange(n), group.astype(np.int64)
    for back in range(REACH + 1):
        if back:
            reach = before_length[live] >= back
            live, left = live[reach], left[reach]
            _, left, size = np.unique(left * 256 + before[live, back - 1], return_inverse=True, return_counts=True)
            # Whoever shares the bytes up to here with nobody shares longer ones with nobody either.
            more = size[left] > 1
            live, left = live[more], left[more]
        if not len(live):
            break
        need = LENGTH - back
        run = np.cumsum(common < need)[live]
        long_enough = after_length[live] >= need
        rows, key = live[long_enough], run[long_enough] * (int(left.max()) + 1) + left[long_enough]
        order = np.lexsort((rank[rows], key))
        again = np.zeros(len(rows), bool)
        again[1:] = key[order[1:]] == key[order[:-1]]
        hit = rows[order[again]]
        nearest[hit] = np.minimum(nearest[hit], back)
        farthest[hit] = back
    return nearest, farthest


def _induced(contexts: DataFrame) -> DataFrame:
    """(id, tid, start, end) of what repeats in the contexts of each gram."""
    ordered = contexts.repartition("gram").sortWithinPartitions("gram", "suffix")

    def work(held: list[tuple]) -> pa.RecordBatch:
        gram, ids, tids, at, suffix, before = zip(*held, strict=True)
        ids, tids, at = (np.array(x, np.int64) for x in (ids, tids, at))
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((at, tids, ids))] = np.arange(len(at))
        group = np.unique(np.array(gram, np.int64), return_inverse=True)[1]
        nearest, farthest = induced_repeats(group, list(suffix), list(before), rank)
        hit = farthest >= 0
        start, end = (at - farthest)[hit], (at - nearest)[hit] + LENGTH
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[hit], tids[hit], start, end)], ["id", "tid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("gram", "id", "tid", "at", "suffix", "before")), strict=True):
                if len(held) >= CHUNK and held[-1][0] != row[0]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    return ordered.mapInArrow(run, f"{_PLACE}, start long, end long")


def _grouped(contexts: DataFrame) -> DataFrame:
    """The same for grams with very many contexts: every string through the anchor, with the first place that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for i, t, at, suffix, before in zip(*(batch.column(c).to_pylist() for c in ("id", "tid", "at", "suffix", "before")), strict=True):
                whole, left = before[::-1] + suffix, len(before)
                out += [(hashlib.blake2b(whole[s : s + LENGTH], digest_size=16).digest(), i, t, at - left + s) for s in range(min(left, REACH) + 1) if s + LENGTH <= len(whole)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["string", "id", "tid", "start"])

    strings = written(contexts.mapInArrow(run, f"string binary, {_PLACE}, start long"), "hot-strings")
    place = F.struct("id", "tid", "start")
    first = strings.groupBy("string").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = strings.join(first, "string").filter(F.col("first") < place)
    return later.select("id", "tid", "start", (F.col("start") + LENGTH).alias("end"))


def dedup_suffixes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row: the maximal removed ranges of bytes, and what is left of the text.

    Strings are judged on the input and never cross documents; of equal ones the one in the smallest id, then at the
    earliest byte, stays. A null or empty text has no bytes. A null id comes before all others. Rows with the same id and
    text are one document and end up alike; different texts with the same id are ordered by a hash. `kept` is binary,
    since a removed range may end inside a character. Other columns are not read.
    """
    body = text_or_empty(text)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(body).alias("tid"), body.alias("text"),
    )
    tuples = written(_first_and_rest(_named(rows)), "suffix-tuples")
    repeats, firsts = tuples.filter("repeat").select("id", "tid", "start", "end"), tuples.filter("not repeat")
    # Both joins below read the texts from this one shuffle.
    moved = rows.repartition("id", "tid")
    hot = firsts.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("gram")
    if hot.isEmpty():
        induced = _induced(_contexts(moved, firsts))
    else:
        induced = _induced(_contexts(moved, firsts.join(hot, "gram", "left_anti")))
        induced = induced.unionByName(_grouped(_contexts(moved, firsts.join(hot, "gram", "left_semi"))))
    ranges = repeats.unionByName(induced).groupBy("id", "tid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = moved.join(ranges, ["id", "tid"], "left").select("doc_id", "text", "ranges")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, spans, left = [], [], []
                for content, own in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    data, merged = content.encode(), []
                    for one in sorted(own or (), key=lambda r: r["start"]):
                        if merged and one["start"] <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], one["end"])
                        else:
                            merged.append(dict(one))
                    cuts = [0, *(x for m in merged for x in (m["start"], m["end"])), len(data)]
                    sizes.append(len(data))
                    spans.append(merged)
                    left.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, schema.field(2).type), pa.array(left, pa.binary())], schema=schema)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
