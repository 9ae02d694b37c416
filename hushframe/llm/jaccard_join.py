"""N-gram Jaccard join with an R-tree over count vectors.

The shingles of a document are hashed into groups; how many fall into each group makes the document a point. Two
documents share at most the sum, over the groups, of the smaller count: that bounds their overlap, for points as well as
for boxes of points, and only pairs that pass are verified on their shingles.

How the index is spread over a cluster. If two sets are similar enough, their points differ by at most R in all. Groups
are dealt into R + 1 + SPARE parts; then the points are equal on more than SPARE parts, so the pair meets under the key
of a part. Empty parts are equal in too many unrelated sets to meet under; SPARE is enough that hardly a set has more of them.
The points that meet under a key are searched in nodes of an R-tree of their own; pairs that pass the bound,
directly or through others, form a candidate component. Its points are sorted into leaves of a tree again, and leaves
whose boxes can hold a pair are compared, first on points with more coordinates for larger sets, which are far smaller
than the sets (those under the keys are such points already, but with a most), and then, in the components that this leaves, on their shingles. Equal sets are one point from the start, so copies never
meet each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.byte_bpe import slices
from hushframe.llm.common import RangeHashes, mixed, span_hashes, text_bytes, text_or_empty, word_spans
from hushframe.llm.components import connected
from hushframe.operators.ordered import sorted_once, with_totals
from hushframe.storage import arrow_bytes, written

#: Empty parts that a document may have without taking part under their keys: so many, and one more for each so many
#: shingles that linked sets may differ in.
SPARE = 2
SPARE_SHARE = 8
#: Coordinates of the points in the tree, shingles of the points of a leaf (a power of two; each point counts as so many more),
#: points of a node inside it.
GROUPS = 128
FOLDED = 16  # coordinates of the boxes of leaves: sums of neighbouring ones
PER_GROUP = 4  # shingles for each coordinate of a finer point, which has `GROUPS` of them at least
MET_GROUPS = 1024  # coordinates of the finer points that meet under keys, at most
FULL = 255  # stands for this count and all above, so that bounds stay bounds
LEAF_BITS = 19
LEAST_WEIGHT = 64
NODE = 16
#: Up to so many ids are broadcast to find the texts of candidates; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Points under one key that are searched for pairs, in all and in one slice of documents; more of them are a crowd, in
#: which all are taken for candidates of each other.
MEETING = 10_000
CROWD = 64
#: Bytes of text in a slice of documents, and in the parts of it whose shingles are in memory at a time; bytes of a batch.
SLICE_BYTES = 4 << 20
SHINGLED_BYTES = 1 << 18
BATCH_BYTES = 8 << 20
#: Bytes of the hash that stands for a set, and bits of a meeting key: they are what travels most.
NAME_BYTES = 12
KEY_SHIFT = np.uint64(16)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Similar:
    """Sets are linked if below * intersection >= above * union, after at least `shingle` words make a shingle."""

    above: int = 90
    below: int = 100
    shingle: int = 3

    def overlap(self, sizes):  # noqa: ANN001, ANN201
        """Shared shingles that two sets of so many in sum need."""
        return -(-self.above * sizes // (self.above + self.below))

    def apart(self, sizes):  # noqa: ANN001, ANN201
        """By how much the points of two linked sets of so many in sum may differ."""
        return sizes * (self.below - self.above) // (self.below + self.above)


def _size_bounds(most: int) -> np.ndarray:
    """First sizes of the classes of sizes; the parts of a class suit all its sizes."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(bounds[-1] * 7 // 5 + 1)
    return np.array(bounds, np.int64)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of the distinct shingles of each text, sorted."""
    flat, offsets = text_bytes(texts)
    flat = _LOWER[flat]
    starts, ends = word_spans(flat, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = span_hashes(flat, starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    hashes = RangeHashes(words)
    at = np.arange(len(words))
    whole = at[at + shingle <= (first + count)[doc]]
    short = np.flatnonzero((count > 0) & (count < shingle))
    owner = np.concatenate([doc[whole], short])
    values = np.concatenate([hashes(whole, whole + shingle), hashes(first[short], first[short] + count[short])])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new]


def _class_names(owner: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, list[bytes | None]]:
    """The size and the name of each set: equal sets have equal names, empty ones none."""
    cuts = np.searchsorted(owner, np.arange(count + 1))
    raw = values.astype("<u8")
    names = [hashlib.blake2b(raw[a:b].data, digest_size=NAME_BYTES).digest() if b > a else None for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.diff(cuts), names


def _part_keys(owner: np.ndarray, values: np.ndarray, sizes: np.ndarray, rule: Similar) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of each part that a set takes part under, in its own class of sizes and those above in reach."""
    bounds = _size_bounds(int(sizes.max(initial=1)) * rule.below // rule.above + 1)
    own = np.searchsorted(bounds, sizes, "right") - 1
    reach = np.searchsorted(bounds, sizes * rule.below // rule.above, "right") - 1
    first = np.searchsorted(owner, np.arange(len(sizes) + 1))
    out_set, out_key = [], []
    steps = int((reach - own)[sizes > 0].max(initial=0))
    spread = mixed(values)
    with np.errstate(over="ignore"):
        for step in range(steps + 1):
            # Sets that must be equal to be linked are one class already.
            kind = own + step
            apart = rule.apart(2 * (bounds[np.minimum(kind + 1, len(bounds) - 1)] - 1))
            chosen = np.flatnonzero((sizes > 0) & (kind <= reach) & (apart > 0))
            if not len(chosen):
                continue
            spare = SPARE + apart[chosen] // SPARE_SHARE
            width = apart[chosen] + 1 + spare
            base = np.cumsum(width) - width
            item = np.concatenate([np.arange(first[s], first[s + 1]) for s in chosen])
            count = first[chosen + 1] - first[chosen]
            part = ((spread[item] >> np.uint64(33)).astype(np.int64)) % np.repeat(width, count)
            cell = np.repeat(base, count) + part
            total = np.zeros(int(width.sum()), np.uint64)
            np.add.at(total, cell, mixed(values[item] + np.uint64(0x51ED270B)))
            filled = np.bincount(cell, minlength=len(total)) > 0
            set_of = np.repeat(np.arange(len(chosen)), width)
            earlier = np.cumsum(~filled) - ~filled
            keep = filled | (earlier - earlier[base][set_of] >= spare[set_of])
            number = np.arange(len(total)) - base[set_of]
            label = (kind[chosen][set_of] * 1_000_003 + number).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
            out_set.append(chosen[set_of][keep])
            out_key.append(mixed(total + label)[keep])
    if not out_set:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_set), np.concatenate(out_key)


def _coarse(owner: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """The point of each set: how many of its shingles fall into each of `GROUPS` groups."""
    group = (mixed(values) >> np.uint64(20)).astype(np.int64) % GROUPS
    return np.bincount(owner * GROUPS + group, minlength=count * GROUPS).reshape(-1, GROUPS)


def fine_point(values: np.ndarray, most: int | None = None) -> bytes:
    """The point of one set with a coordinate for up to `PER_GROUP` shingles: a power of two of them, so that points fold.

    With `most` (a power of two), there are no more coordinates than that.
    """
    width = max(GROUPS, 1 << (max(len(values) // PER_GROUP, 1) - 1).bit_length())
    width = width if most is None else min(width, most)
    group = (mixed(values) >> np.uint64(20)).astype(np.int64) % width
    return np.minimum(np.bincount(group, minlength=width), FULL).astype(np.uint8).tobytes()


def _folded_points(raw: list[bytes]) -> np.ndarray:
    """Finer points with as many coordinates as the shortest of them has: sums keep bounds."""
    width = min(len(r) for r in raw)
    points = np.empty((len(raw), width), np.int64)
    for i, r in enumerate(raw):
        own = np.frombuffer(r, np.uint8).astype(np.int64)
        own[own == FULL] = 1 << 40
        points[i] = own.reshape(-1, width).sum(0)
    return points


def document_classes(docs: DataFrame, rule: Similar) -> DataFrame:
    """(doc_id, n_shingles, class, point, folded): documents with equal sets have the same class; empty sets have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SHINGLED_BYTES):
                owner, values = shingle_sets(part.column("text"), rule.shingle)
                sizes, names = _class_names(owner, values, part.num_rows)
                points = _coarse(owner, values, part.num_rows)
                folded = points.reshape(part.num_rows, FOLDED, -1).sum(2)
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                columns = [
                    part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                    pa.array([fine_point(values[a:b], MET_GROUPS) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * FOLDED, pa.int32()), pa.array(folded.ravel(), pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "class", "point", "folded"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class binary, point binary, folded array<int>")


def _slice_keys(part: pa.RecordBatch, rule: Similar) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """The names of the sets of a slice, and (set number, key) of the parts of the first of equal sets.

    Shingles take many times the memory of the text, keys do not: only those of a small part of the slice are held.
    """
    names: list[bytes | None] = []
    seen: set[bytes] = set()
    out_set, out_key = [], []
    for small in slices(part, "text", SHINGLED_BYTES):
        owner, values = shingle_sets(small.column("text"), rule.shingle)
        sizes, own = _class_names(owner, values, small.num_rows)
        fresh = np.zeros(small.num_rows, bool)
        for i, name in enumerate(own):
            if name is not None and name not in seen:
                seen.add(name)
                fresh[i] = True
        kept = fresh[owner]
        sets, keys = _part_keys(owner[kept], values[kept], np.where(fresh, sizes, 0), rule)
        out_set.append(sets + len(names))
        out_key.append(keys)
        names += own
    return names, np.concatenate(out_set), np.concatenate(out_key)


def _meetings(docs: DataFrame, rule: Similar) -> DataFrame:
    """(key, class, crowd): classes under the same key may be linked.

    Where a slice of documents has a crowd under a key, it says the key once: the other classes are tied to the first by
    keys of their own, so a part that many documents share does not make a hot key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                names, sets, keys = _slice_keys(part, rule)
                order = np.argsort(keys, kind="stable")
                sets, keys = sets[order], keys[order]
                head = np.ones(len(keys), bool)
                head[1:] = keys[1:] != keys[:-1]
                run_of = np.cumsum(head) - 1
                lead = sets[np.flatnonzero(head)][run_of]
                crowd = (np.bincount(run_of) > CROWD)[run_of] if len(keys) else head
                tied = np.unique(np.column_stack([lead[crowd & ~head], sets[crowd & ~head]]), axis=0)
                tied = tied[tied[:, 0] != tied[:, 1]]
                with np.errstate(over="ignore"):
                    tie = mixed(np.frombuffer(b"".join(names[a][:8] for a in tied[:, 0]), "<u8") * np.uint64(3) + np.frombuffer(b"".join(names[b][:8] for b in tied[:, 1]), "<u8"))
                own = head | ~crowd
                all_keys = (np.concatenate([keys[own], tie, tie]) >> KEY_SHIFT).view(np.int64)
                all_sets = np.concatenate([sets[own], tied[:, 0], tied[:, 1]])
                table = pa.array(names, pa.binary()).take(pa.array(all_sets, pa.int64()))
                flags = np.concatenate([crowd[own], np.ones(2 * len(tie), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(all_keys), table, pa.array(flags)], ["key", "class", "crowd"])

    return docs.select("text").mapInArrow(run, "key long, class binary, crowd boolean")


def _candidate_edges(meetings: DataFrame, classes: DataFrame, rule: Similar) -> DataFrame:
    """(a, b): pairs under a key that pass the bound on their points, as many as connect them.

    Most keys have one class; only the others bring the points of theirs. In a crowd, neighbours in the list are taken
    for candidates: that connects them all, so no pair is lost. A key is a crowd if any slice says so, whichever rows of
    a class stay.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy("class")
    beside = F.coalesce(F.lag("class").over(order) != F.col("class"), F.lit(False)) | F.coalesce(
        F.lead("class").over(order) != F.col("class"), F.lit(False)
    )
    crowd = F.max("crowd").over(Window.partitionBy("key"))
    shared = meetings.select("key", "class", crowd.alias("crowd"), beside.alias("beside")).filter("beside").drop("beside")
    rows = shared.join(classes.select("class", "n", "point"), "class").repartition("key").sortWithinPartitions("key", F.desc("crowd"), "n", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, crowd = None, {}, None

        def pairs() -> list[tuple[bytes, bytes]]:
            names = list(held)
            points = _folded_points([p for _, p in held.values()])
            sizes = np.array([n for n, _ in held.values()], np.int64)
            return [(names[i], names[j]) for i, j in linked_pairs(points, sizes, None, None, rule)]

        out: list[tuple[bytes, bytes]] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "class", "crowd", "n", "point")]
            for key, name, many, n, point in zip(*columns, strict=True):
                if key != current:
                    if len(held) > 1:
                        out += pairs()
                    current, held, crowd = key, {}, name if many else None
                if crowd is not None:
                    if name != crowd:
                        out.append((crowd, name))
                        crowd = name
                    continue
                held[name] = n, point
                if len(held) > MEETING:
                    names = list(held)
                    out += zip(names[:-1], names[1:], strict=True)
                    held, crowd = {}, names[-1]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])
            out = []
        if len(held) > 1:
            out = pairs()
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

    return rows.select("key", "class", "crowd", "n", "point").mapInArrow(run, "a binary, b binary")


def _visits(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, visits): the pairs of leaves that each point is compared in."""
    both = pairs.select("component", "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("leaf"))
    dealt = members.select("component", "leaf", "class", "place").join(both, ["component", "leaf"])
    return dealt.groupBy("class").agg(F.collect_list(F.struct("component", "one", "two", "leaf", "place")).alias("visits"))


def _with_sets(docs: DataFrame, chosen: DataFrame, rule: Similar, fine: bool) -> DataFrame:
    """One row per visit of the chosen (rep, class, visits) classes, with size and shingles from the text of `rep`, or with
    their finer point."""
    few = chosen.count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(chosen) if few else chosen, F.col("doc_id") == F.col("rep")).select("text", "class", "visits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SHINGLED_BYTES):
                owner, values = shingle_sets(part.column("text"), rule.shingle)
                _, names = _class_names(owner, values, part.num_rows)
                raw, cuts = values.astype("<u8"), np.searchsorted(owner, np.arange(part.num_rows + 1))
                for i, (name, own, visits) in enumerate(zip(names, part.column("class").to_pylist(), part.column("visits").to_pylist(), strict=True)):
                    if name != own:
                        continue
                    content = values[cuts[i] : cuts[i + 1]]
                    body = fine_point(content) if fine else raw[cuts[i] : cuts[i + 1]].tobytes()
                    columns = {c: [v[c] for v in visits] for c in ("component", "one", "two", "leaf", "place")}
                    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                    arrays = [pa.array(x, k) for x, k in zip(columns.values(), kinds, strict=True)]
                    copies = len(visits)
                    yield pa.RecordBatch.from_arrays(
                        [*arrays, pa.array([name] * copies, pa.binary()), pa.array([len(content)] * copies, pa.int64()), pa.array([body] * copies, pa.binary())],
                        [*columns, "class", "n", "body"],
                    )

    return found.mapInArrow(run, "component binary, one long, two long, leaf long, place long, class binary, n long, body binary")


def _leaf_pairs(members: DataFrame, rule: Similar) -> DataFrame:
    """(component, one, two): leaves of a component, one <= two, whose boxes can hold a linked pair."""
    high = F.array(*[F.max(F.col("folded")[g]) for g in range(FOLDED)])
    boxes = members.groupBy("component", "leaf").agg(F.min("n").alias("low_n"), F.max("n").alias("high_n"), high.alias("high"))
    one = boxes.select("component", *[F.col(c).alias(f"{c}_1") for c in ("leaf", "low_n", "high_n", "high")])
    two = boxes.select("component", *[F.col(c).alias(f"{c}_2") for c in ("leaf", "low_n", "high_n", "high")])
    bound = F.aggregate(F.zip_with("high_1", "high_2", lambda a, b: F.least(a, b)), F.lit(0), lambda total, part: total + part)
    least = F.col("low_n_1") + F.col("low_n_2")
    fits = (
        (F.col("leaf_1") <= F.col("leaf_2"))
        & (rule.below * F.least("high_n_1", "high_n_2") >= rule.above * F.greatest("low_n_1", "low_n_2"))
        & ((rule.above + rule.below) * bound >= rule.above * least)
    )
    return one.join(two, "component").filter(fits).select("component", F.col("leaf_1").alias("one"), F.col("leaf_2").alias("two"))


def linked_pairs(
    points: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray] | None, side: np.ndarray | None, rule: Similar
) -> list[tuple[int, int]]:
    """Links that connect what is linked: pairs already connected through others are not verified again.

    Points are nodes of `NODE` neighbours in their order. With `side`, only pairs of different sides are compared.
    Without `sets`, the pairs are those that pass the bound on their points. Bounds are only worked out between points that
    are not connected yet, so a group of copies takes little more than its links.
    """
    n = len(sizes)
    group = np.arange(n)
    starts = np.arange(0, n, NODE)
    high = np.maximum.reduceat(points, starts, axis=0)
    low_n, high_n = np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts)
    links = []
    for i in range(n):
        other = group != group[i]
        fits = np.logical_or.reduceat(other, starts) & (rule.below * high_n >= rule.above * sizes[i]) & (rule.below * sizes[i] >= rule.above * low_n)
        fits[: i // NODE] = False
        node = np.flatnonzero(fits)
        node = node[rule.overlap(sizes[i] + low_n[node]) <= np.minimum(high[node], points[i]).sum(1)]
        near = (starts[node][:, None] + np.arange(NODE)).ravel()
        near = near[(near > i) & (near < n)]
        near = near[other[near]]
        if side is not None:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        need = rule.overlap(sizes[i] + sizes[near])
        near, need = (x[np.minimum(points[near], points[i]).sum(1) >= need] for x in (near, need))
        for j, least in zip(near.tolist(), need.tolist(), strict=True):
            if group[i] != group[j] and (sets is None or np.intersect1d(sets[i], sets[j], assume_unique=True).size >= least):
                group[group == group[j]] = group[i]
                links.append((i, j))
    return links


def _links(rows: DataFrame, rule: Similar, fine: bool) -> DataFrame:
    """(a, b): verified links between the classes that visit the same pair of leaves; with finer points, those that may be."""
    rows = rows.repartition("component", "one", "two").sortWithinPartitions("component", "one", "two", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def done() -> pa.RecordBatch:
            group = {row[0]: row for row in held}
            names = list(group)
            sizes = np.array([row[1] for row in group.values()], np.int64)
            if fine:
                sets, point = None, _folded_points([row[2] for row in group.values()])
            else:
                sets = [np.frombuffer(row[2], "<u8") for row in group.values()]
                point = _coarse(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), len(sets))
            leaf = np.array([row[3] for row in group.values()], np.int64)
            side = None if current[1] == current[2] else leaf
            found = linked_pairs(point, sizes, sets, side, rule)
            return pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i, _ in found], pa.binary()), pa.array([names[j] for _, j in found], pa.binary())], ["a", "b"]
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "one", "two", "class", "n", "body", "leaf")]
            for component, one, two, *row in zip(*columns, strict=True):
                if (component, one, two) != current:
                    if held:
                        yield done()
                    current, held = (component, one, two), []
                held.append(row)
        if held:
            yield done()

    return rows.mapInArrow(run, "a binary, b binary")


def _compared(candidates: DataFrame, classes: DataFrame, named: DataFrame, rule: Similar, fine: bool) -> DataFrame:
    """(a, b): links within candidate components (node, component), as many as connect them; with `fine`, of points only."""
    members = candidates.join(classes, F.col("node") == F.col("class")).select("component", "n", "folded", "class")
    # Leaves hold about as many shingles each, not as many points: what a leaf sends is the same for short and long texts,
    # and so few leaves meet.
    weighed = members.withColumn("weight", (F.col("n") + LEAST_WEIGHT).cast("bigint"))
    members = with_totals(sorted_once(weighed, ("component",), ("n", "folded", "class"), "jaccard-leaves"), ("component",), {"place": "weight"})
    members = members.withColumn("leaf", F.shiftright("place", LEAF_BITS))
    visits = _visits(members, _leaf_pairs(members, rule)).join(classes.select("class", "rep"), "class")
    return _links(_with_sets(named, written(visits, "jaccard-visits"), rule, fine), rule, fine)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Similar = Similar()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest id that links lead to, its own included.

    Words are runs of non-space characters, with A-Z in lower case; a text of fewer than `rule.shingle` words is one
    shingle. A null, empty or wordless text has no shingles and is linked with nothing. Rows with a null id get their
    n_shingles and no component, and link nothing. Rows with equal ids share what each of them links. A 64-bit
    hash stands for a shingle, and one of 96 bits for a set. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    # All that goes through Python is worked off in here.
    with arrow_bytes(docs.sparkSession, BATCH_BYTES):
        known = written(document_classes(rows, rule), "jaccard-classes")
        named = rows.filter("doc_id is not null")
        placed = known.filter("class is not null and doc_id is not null")
        classes = placed.groupBy("class").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("point").alias("point"), F.first("folded").alias("folded")
        )
        firsts = classes.select("class", "rep")
        candidates = connected(_candidate_edges(_meetings(named, rule), classes, rule))
        # What the meeting keys tie together are not all near each other: finer points tell that before any set travels.
        candidates = connected(_compared(candidates, classes, named, rule, fine=True))
        linked = connected(_compared(candidates, classes, named, rule, fine=False))
    linked = linked.join(firsts, F.col("node") == F.col("class")).select("class", "component", "rep")
    smallest = linked.groupBy("component").agg(F.min("rep").alias("linked_id"))
    labels = firsts.join(linked.join(smallest, "component").select("class", "linked_id"), "class", "left")
    labels = labels.select("class", F.coalesce("linked_id", "rep").alias("found_id"))
    joined = known.join(labels, "class", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found_id", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))
