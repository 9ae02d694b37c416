"""Substring dedup on words: remove every word that lies in a window of `SIZE` words which also starts earlier.

Super-k-mer partitioning. The minimiser of a window is the leftmost of its grams of `GRAM` words with the smallest hash:
equal windows have equal minimisers, and one window cannot occur twice under the same gram of a text. Consecutive
windows that share their minimiser form a super-k-mer; it travels as one packed string, its words joined by spaces, to
the bucket of its minimiser, where the windows are sorted and each but the first of equal ones is a repeat.

What need not travel as a string stays at home. A super-k-mer is announced by its minimiser, a name (a second hash of
all its words) and its place. Of equal names all but the first are repeats as a whole; a minimiser with one name has
nothing to sort. Only super-k-mers of minimisers with several names are packed. A minimiser with more than `HOT` of
them is no bucket for one task: their windows travel alone, grouped by the window itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.byte_bpe import slices
from hushframe.llm.common import RangeHashes, mixed, span_hashes, text_bytes, text_or_empty, word_spans
from hushframe.storage import written

SIZE = 20
GRAM = 5
#: Super-k-mers that are sorted at once, and the most that one minimiser may have before its windows travel alone.
CHUNK = 20_000
HOT = 1_000
#: Up to so many hot minimisers are broadcast; there is at most one for each HOT super-k-mers.
BROADCAST_HOT = 200_000
#: Bytes of text that are searched at once.
SLICE_BYTES = 4 << 20
_LOW = np.uint64(32)
_PLACE = "id long, tid long"


def super_kmers(flat: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text number, first word, windows, minimiser, name) of each super-k-mer; words are counted within their text.

    Minimisers and names come from independent hashes of the words.
    """
    starts, ends = word_spans(flat, offsets)
    none = np.zeros(0, np.int64)
    if len(starts) < size:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    words, others = span_hashes(flat, starts, ends), span_hashes(flat ^ np.uint8(0x5A), starts, ends)
    at = np.arange(len(words) - gram + 1)
    grams = RangeHashes(words)(at, at + gram)
    # Half a hash above the position: the minimum is the leftmost of the smallest, and says where it is.
    keys, have, width = ((grams >> _LOW) << _LOW) | at.astype(np.uint64), 1, size - gram + 1
    while have < width:
        step = min(have, width - have)
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    window = np.arange(len(keys))
    window = window[doc[window] == doc[window + size - 1]]
    place = (keys[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(window)))
    first = window[head]
    name = RangeHashes(others)(first, first + count + size - 1)
    before = np.searchsorted(doc, np.arange(len(offsets)))
    return doc[first], first - before[doc[first]], count, grams[place[head]], name


def _announced(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """(minimiser, name, id, tid, start, end, repeat): the words [start, end) of super-k-mers.

    Of equal ones in a slice only the first is announced under its minimiser; the others are repeats already, and
    neighbouring ones come as one range under a key of their own, so that a passage of a third of all documents makes
    no hot key. Of repeated rows in a slice one is read.
    """
    names = ["minimiser", "name", "id", "tid", "start", "end", "repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                keys = np.column_stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tid")])
                single = np.unique(keys, axis=0, return_index=True)[1]
                if len(single) < len(keys):
                    part = part.take(pa.array(np.sort(single)))
                doc, start, count, minimiser, name = super_kmers(*text_bytes(part.column("text")), size, gram)
                ids, tids = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("id", "tid"))
                end = start + count + size - 1
                order = np.lexsort((start, tids, ids, name, minimiser))
                repeat = np.zeros(len(order), bool)
                repeat[order[1:]] = (minimiser[order[1:]] == minimiser[order[:-1]]) & (name[order[1:]] == name[order[:-1]])
                # Repeats that overlap in one text are one range.
                again = np.flatnonzero(repeat)
                joins = (doc[again[1:]] == doc[again[:-1]]) & (start[again[1:]] <= end[again[:-1]])
                head = np.flatnonzero(np.append(True, ~joins)[: len(again)])
                tail = np.append(head[1:] - 1, len(again) - 1)[: len(head)]
                end[again[head]] = end[again[tail]]
                keep = ~repeat
                keep[again[head]] = True
                key = np.where(repeat, mixed(minimiser + np.arange(len(repeat), dtype=np.uint64)), minimiser)
                columns = [key.view(np.int64), name.view(np.int64), ids, tids, start, end]
                yield pa.RecordBatch.from_arrays([*[pa.array(c[keep]) for c in columns], pa.array(repeat[keep])], names)

    return docs.select("id", "tid", "text").mapInArrow(run, f"minimiser long, name long, {_PLACE}, start long, end long, repeat boolean")


def _sorted_out(announced: DataFrame) -> DataFrame:
    """(minimiser, id, tid, start, end, repeat): whole repeats, and the first super-k-mer of each name that has to be sorted.

    Reads a sorted stream: a task holds a batch and one row. One place may be announced by several slices if its row is
    repeated; only one of them counts.
    """
    ordered = announced.repartition("minimiser").sortWithinPartitions("repeat", "minimiser", "name", "id", "tid", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # minimiser, name, id, tid and start of the row before
        waiting: pa.RecordBatch | None = None  # the only name so far of the last minimiser
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("minimiser", "name", "id", "tid", "start")]
            whole = batch.column("repeat").to_numpy(zero_copy_only=False)
            equal = [np.append(last is not None and x[0] == last[k], x[1:] == x[:-1]) for k, x in enumerate(key)]
            same_bucket = equal[0] & ~whole
            same_name = same_bucket & equal[1]
            same_place = same_name & equal[2] & equal[3] & equal[4]
            heads = np.flatnonzero(~whole & ~same_name)
            follows = same_bucket[heads]
            chosen = follows.copy()
            chosen[:-1] |= follows[1:]
            if len(heads):
                if waiting is not None and follows[0]:
                    yield waiting
                waiting = None if chosen[-1] else batch.slice(int(heads[-1]), 1).drop_columns(["name"])
            keep = whole | (same_name & ~same_place)
            out = batch.set_column(batch.schema.get_field_index("repeat"), "repeat", pa.array(keep)).drop_columns(["name"])
            keep[heads[chosen]] = True
            yield out.filter(pa.array(keep))
            last = None if whole[-1] else tuple(x[-1] for x in key)

    return ordered.mapInArrow(run, f"minimiser long, {_PLACE}, start long, end long, repeat boolean")


def _words(data: bytes) -> list[bytes]:
    """bytes.split() splits at the six ASCII white-space characters and at nothing else."""
    return data.split()


def _packed(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(minimiser, id, tid, start, packed) of the chosen super-k-mers."""
    lists = chosen.groupBy("id", "tid").agg(F.collect_list(F.struct("minimiser", "start", "end")).alias("parts"))
    # Repeated rows have the same places: one of them is enough.
    joined = rows.join(lists, ["id", "tid"]).select("id", "tid", "text", "parts").dropDuplicates(["id", "tid"])
    names = ["minimiser", "id", "tid", "start", "packed"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for i, t, text, parts in zip(*(batch.column(c) for c in ("id", "tid", "text", "parts")), strict=True):
                words = _words(text.as_py().encode())
                for p in parts.as_py():
                    out.append((p["minimiser"], i.as_py(), t.as_py(), p["start"], b" ".join(words[p["start"] : p["end"]])))
                    if len(out) >= CHUNK:
                        yield made(out)
                        out = []
        yield made(out)

    return joined.mapInArrow(run, f"minimiser long, {_PLACE}, start long, packed binary")


def windows_of(packed: bytes, size: int) -> list[bytes]:
    """The windows of a packed super-k-mer, in order."""
    cuts, at = [0], packed.find(b" ")
    while at >= 0:
        cuts.append(at + 1)
        at = packed.find(b" ", at + 1)
    cuts.append(len(packed) + 1)
    return [packed[cuts[k] : cuts[k + size] - 1] for k in range(len(cuts) - size)]


def _counted(packed: DataFrame, size: int) -> DataFrame:
    """(id, tid, start, end) of the windows that also start earlier, from the sorted windows of each bucket."""
    ordered = packed.repartition("minimiser").sortWithinPartitions("minimiser")

    def work(held: list[tuple]) -> pa.RecordBatch:
        # By place: then windows are numbered by place too, since super-k-mers of one text do not interleave.
        held = sorted(held, key=lambda row: row[1:4])
        windows, owner = [], []
        for number, row in enumerate(held):
            own = windows_of(row[4], size)
            windows += own
            owner += [(number, k) for k in range(len(own))]
        order = sorted(range(len(windows)), key=windows.__getitem__)
        again = [b for a, b in zip(order, order[1:], strict=False) if windows[a] == windows[b]]
        spans: list[list[int]] = []
        for number, k in sorted(owner[w] for w in again):
            start = held[number][3] + k
            if spans and spans[-1][0] == number and start <= spans[-1][2]:
                spans[-1][2] = start + size
            else:
                spans.append([number, start, start + size])
        columns = [[held[n][c] for n, _, _ in spans] for c in (1, 2)] + [[s[k] for s in spans] for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "tid", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("minimiser", "id", "tid", "start", "packed")), strict=True):
                if len(held) >= CHUNK and held[-1][0] != row[0]:
                    yield work(held)
                    held = []
                held.append(row)
        if held:
            yield work(held)

    return ordered.mapInArrow(run, f"{_PLACE}, start long, end long")


def _alone(packed: DataFrame, size: int) -> DataFrame:
    """The same for hot minimisers: whatever is not the first place of its window is a repeat. No join on windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = zip(*(batch.slice(start, 1000).column(c).to_pylist() for c in ("id", "tid", "start", "packed")), strict=True)
                out = [(w, i, t, s + k) for i, t, s, p in rows for k, w in enumerate(windows_of(p, size))]
                columns = list(zip(*out, strict=True)) or [()] * 4
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["window", "id", "tid", "start"])

    single = written(packed.mapInArrow(run, f"window binary, {_PLACE}, start long"), "hot-windows")
    firsts = single.groupBy("window").agg(F.min(F.struct("id", "tid", "start")).alias("first")).select("first.*")
    later = single.select("id", "tid", "start").join(firsts, ["id", "tid", "start"], "left_anti")
    return later.withColumn("end", F.col("start") + size)


def dedup_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, spans, kept) of every row: the maximal removed ranges of words, and the other words joined by spaces.

    Words are runs of anything but the six ASCII white-space characters. Windows are judged on the input and never cross
    documents; of equal ones the one in the smallest id, then at the earliest word, stays. A null or empty text has no
    words, one of fewer than `size` words no window. A null id comes before all others. Rows with the same id and text
    are one document and end up alike; different texts with the same id are ordered by a hash. Other columns are not
    read, whatever their names.
    """
    body = text_or_empty(text)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(body).alias("tid"), body.alias("text"),
    )
    # Shorter texts cannot have a window. They take no part in the joins, where equal ones would be one hot key.
    short = F.length("text") < 2 * size - 1
    long_rows = rows.filter(~short)
    found = written(_sorted_out(_announced(long_rows, size, gram)), "super-kmers")
    repeats, chosen = found.filter("repeat").select("id", "tid", "start", "end"), found.filter("not repeat").drop("repeat")
    crowded = written(chosen.groupBy("minimiser").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("minimiser"), "hot-minimisers")
    count = crowded.count()
    if not count:
        counted = _counted(_packed(long_rows, chosen), size)
    else:
        crowded = F.broadcast(crowded) if count <= BROADCAST_HOT else crowded
        counted = _counted(_packed(long_rows, chosen.join(crowded, "minimiser", "left_anti")), size)
        counted = counted.unionByName(_alone(_packed(long_rows, chosen.join(crowded, "minimiser", "left_semi")), size))
    ranges = repeats.unionByName(counted).groupBy("id", "tid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = long_rows.join(ranges, ["id", "tid"], "left").select("doc_id", "text", "ranges")
    none = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    joined = joined.unionByName(rows.filter(short).select("doc_id", "text", none.alias("ranges")))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, spans, left = [], [], []
                for content, own in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    words, merged = _words(content.encode()), []
                    for one in sorted(own or (), key=lambda r: r["start"]):
                        if merged and one["start"] <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], one["end"])
                        else:
                            merged.append(dict(one))
                    cuts = [0, *(x for m in merged for x in (m["start"], m["end"])), len(words)]
                    counts.append(len(words))
                    spans.append(merged)
                    left.append(b" ".join(w for a, b in zip(cuts[::2], cuts[1::2], strict=True) for w in words[a:b]).decode())
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, schema.field(2).type), pa.array(left, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return joined.mapInArrow(run, "doc_id long, n_words long, spans array<struct<start:long,end:long>>, kept string")
