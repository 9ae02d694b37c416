import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hushframe.llm import jaccard_join
from hushframe.llm.components import connected
from hushframe.llm.jaccard_join import Similar, jaccard_components
from hushframe.storage import arrow_bytes
from tests.llm import brute


def near_texts(seed: int = 3) -> dict[int, str | None]:
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts: list[str | None] = [None, "", "  \n", "one", "One", "one two", "ONE\ttwo", "a b c", "a b c d", "ß " * 40]
    for size in (3, 5, 9, 10, 11, 14, 15, 20, 30, 60, 150, 400, 1500):
        for _ in range(3):
            base = draw.choices(vocabulary, k=size)
            texts.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for _ in range(draw.randint(0, max(1, size // 45))):
                    copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
                if draw.random() < 0.3:
                    copy += draw.choices(vocabulary, k=max(1, size // 30))
                texts.append(" ".join(copy))
    draw.shuffle(texts)
    return dict(enumerate(texts))


def found(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("leaf_bits", [8, 2, 4])
def test_components_are_those_of_all_pairs(spark, monkeypatch, leaf_bits):
    monkeypatch.setattr(jaccard_join, "LEAF_BITS", leaf_bits)
    texts = near_texts(leaf_bits)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute.components(texts)
    assert len({c for _, c in want.values()}) < len(texts) - 60
    assert found(jaccard_components(docs).collect()) == want


def test_other_thresholds(spark):
    texts = {d: t for d, t in near_texts(9).items() if t is None or len(t) < 900}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = found(jaccard_components(docs, rule=Similar(80, 100, 5)).collect())
    sets = {d: brute.shingles(t, 5) for d, t in texts.items()}
    for d, s in sets.items():
        for e, t in sets.items():
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                assert got[d][1] == got[e][1]


def test_odd_rows(spark):
    rows = [(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 2), (3, "A b c d", 3), (9, None, 4), (8, "", 5), (2, "a b c d e f g", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component long")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect())
    assert got == [(-1, 2, None), (2, 5, 2), (3, 2, 3), (5, 2, 3), (5, 2, 3), (8, 0, 8), (9, 0, 9)]
    assert jaccard_components(docs.limit(0)).count() == 0


def test_connected_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1005), (1005, 1000), (7, 7)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1005: 1000}


def test_a_crowd_of_near_copies(spark):
    """More near copies than are searched under one key, in one slice and in many."""
    draw = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for d in range(400):
        words = list(base)
        words[draw.randrange(60)] = f"x{d}"
        texts[d] = " ".join(words)
    texts |= {500 + d: " ".join(draw.sample(base, 60)) for d in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute.components(texts)
    for parts in (1, 40):
        assert found(jaccard_components(docs.repartition(parts)).collect()) == want


def test_a_crowd_whose_lead_has_copies_in_other_slices(spark):
    """The key stays a crowd, whichever of the equal rows of its lead are left: what is tied to the lead may be linked with the other class."""
    lead, other = b"lead", b"other"
    rows = [(key, lead, copy == key) for key in range(20) for copy in range(20)] + [(key, other, False) for key in range(20)]
    alone = [(100 + key, name, False) for key in range(20) for name in (lead, lead, other)]
    points = [(lead, 60, bytes([60] + [0] * 127)), (other, 60, bytes([0] * 127 + [60]))]
    classes = spark.createDataFrame(points, "class binary, n long, point binary")

    def edges(meetings):
        made = spark.createDataFrame(meetings, "key long, class binary, crowd boolean").repartition(4)
        return [{bytes(r["a"]), bytes(r["b"])} for r in jaccard_join._candidate_edges(made, classes, Similar()).collect()]

    assert edges(rows) == [{lead, other}] * 20
    assert edges(alone) == []


def test_finer_points_bound_the_overlap_and_tell_unrelated_long_sets_apart():
    draw = np.random.default_rng(8)
    rule = Similar(above=80, below=100, shingle=5)
    common = draw.integers(0, 2**63, 2_000).astype(np.uint64)
    sets = [np.unique(np.concatenate([common[:k], draw.integers(0, 2**63, 4_000 - k).astype(np.uint64)])) for k in (0, 2_000, 2_000, 0)]
    sets += [np.unique(np.append(sets[0][:-300], draw.integers(0, 2**63, 300).astype(np.uint64))), sets[1][:90]]
    points = jaccard_join._folded_points([jaccard_join.fine_point(s) for s in sets[:5]])
    sizes = np.array([len(s) for s in sets[:5]])
    owner = np.repeat(np.arange(5), sizes)
    rough = jaccard_join._coarse(owner, np.concatenate(sets[:5]), 5)
    # With 128 coordinates, texts that share nothing pass for near duplicates.
    assert len(jaccard_join.linked_pairs(rough, sizes, None, None, rule)) > 1
    assert jaccard_join.linked_pairs(points, sizes, None, None, rule) == [(0, 4)]
    mixed_up = jaccard_join._folded_points([jaccard_join.fine_point(s) for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.minimum(mixed_up[i], mixed_up[j]).sum() >= np.intersect1d(a, b).size


class Worked:
    """In place of a table: the work on batches is not sent to tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, work, schema):  # noqa: N802
        return work


def test_memory_follows_a_part_of_a_slice():
    draw = random.Random(7)
    texts = [" ".join(draw.choices("abcdefghij", k=2) + [f"w{draw.randrange(9000)}" for _ in range(600)]) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, texts[0], ""])], ["text"])
    work = jaccard_join._meetings(Worked(), Similar(80, 100, 5))
    tracemalloc.start()
    made = sum(part.num_rows for part in work(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made > 100_000 and peak < 45e6


def test_parts_of_a_slice_have_the_keys_of_the_slice(monkeypatch):
    texts = [text for _, text in sorted(near_texts().items())]
    batch = pa.RecordBatch.from_arrays([pa.array([text or "" for text in texts * 2])], ["text"])
    whole = jaccard_join._slice_keys(batch, Similar())
    monkeypatch.setattr(jaccard_join, "SHINGLED_BYTES", 300)
    parts = jaccard_join._slice_keys(batch, Similar())
    assert whole[0] == parts[0]
    assert sorted(zip(whole[1].tolist(), whole[2].tolist(), strict=True)) == sorted(zip(parts[1].tolist(), parts[2].tolist(), strict=True))


def test_batches_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    rows = spark.range(4000, numPartitions=1).selectExpr("id", "repeat(concat('w', id, ' '), 800) as text")
    with arrow_bytes(spark, 1 << 20):
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert len(sizes) > 10 and max(r["n"] for r in sizes) < 3 << 19
    assert spark.conf.get(name) == before


def test_texts_travel_in_bounded_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(name), []
    for step in ("document_classes", "_meetings", "_with_sets"):
        real = getattr(jaccard_join, step)
        monkeypatch.setattr(jaccard_join, step, lambda *a, real=real: (seen.append(spark.conf.get(name)), real(*a))[1])
    rows = [(i, "a b c d e f g h i j k l m n o p" + " q" * (i % 2)) for i in range(4)]
    assert {r["component_id"] for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), rule=Similar(80, 100, 3)).collect()} == {0}
    assert set(seen) == {str(jaccard_join.BATCH_BYTES)} and len(seen) >= 3 and spark.conf.get(name) == before


def drawn(draw, count):
    return np.sort(draw.integers(0, 2**63, count).astype(np.uint64))


def keys_of(sets, rule):
    sizes = np.array([len(s) for s in sets])
    sets_of, keys = jaccard_join._part_keys(np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets), sizes, rule)
    return [set(keys[sets_of == i].tolist()) for i in range(len(sets))]


@pytest.mark.parametrize("rule", [Similar(80, 100, 5), Similar()])
def test_unrelated_sets_do_not_meet_under_empty_parts(rule):
    """Else those of like sizes all meet, and pairs under keys grow with the square of their number."""
    draw = np.random.default_rng(5)
    under = Counter(key for own in keys_of([drawn(draw, draw.integers(280, 420)) for _ in range(600)], rule) for key in own)
    assert sum(n * (n - 1) // 2 for n in under.values()) < 600


@pytest.mark.parametrize("rule", [Similar(80, 100, 5), Similar()])
def test_sets_at_the_limit_meet(rule):
    """However few shingles there are for the parts, also where one set has all the others and in another class of sizes."""
    draw = np.random.default_rng(6)
    for size in [*range(5, 60), 97, 140, 275, 386, 1000, 3000]:
        whole = drawn(draw, size)
        part = draw.permutation(whole)[: -(-rule.above * size // rule.below)]
        changed = np.concatenate([draw.permutation(whole)[: -(-rule.above * 2 * size // (rule.above + rule.below))], drawn(draw, size)])[:size]
        for other in (np.sort(part), np.sort(changed)):
            common = len(np.intersect1d(whole, other))
            assert rule.below * common >= rule.above * (size + len(other) - common)
            if not np.array_equal(whole, other):
                one, two = keys_of([whole, other], rule)
                assert one & two


def test_unrelated_long_texts_under_a_key_are_no_candidates():
    draw = random.Random(9)
    rule = Similar(80, 100, 5)
    texts = [" ".join(f"w{draw.randrange(9000)}" for _ in range(6000)) for _ in range(6)]
    texts.append(texts[0] + " end")
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    made = pa.Table.from_batches(jaccard_join.document_classes(Worked(), rule)(iter([batch])))
    points, sizes = made.column("point").to_pylist(), np.array(made.column("n_shingles").to_pylist())
    assert jaccard_join.linked_pairs(jaccard_join._folded_points(points), sizes, None, None, rule) == [(0, 6)]
    assert max(map(len, points)) <= jaccard_join.MET_GROUPS
