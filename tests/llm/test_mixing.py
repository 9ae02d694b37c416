import random
from collections import Counter

import pytest

from hushframe.llm import mixing
from hushframe.llm.mixing import emit, mix


def targets(sizes):
    """Share, stop, share again, source by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        parts = sum(weight[s] for s in order if s not in full)
        out = {s: 3 * sizes[s] if s in full else left * weight[s] / parts for s in order}
        over = {s for s in order if s not in full and out[s] >= 3 * sizes[s]}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("salted", [False, True])
def test_targets_and_copies(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    draw = random.Random(7)
    sources = ["b", "a", "Z", "é", "", None, "rare", "日本"]
    rows = [(i, " ".join(["w"] * draw.randint(0, 30)), draw.choices(sources, [9, 500, 300, 40, 90, 60, 2, 99])[0]) for i in range(4000)]
    rows += [(9001, None, "nothing"), (9002, "", "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    mixed = mix(df)
    got = {r["row"]["doc_id"]: r for r in mixed.collect()}
    sizes = Counter()
    for d, text, source in rows:
        sizes[source] += len((text or "").split())
        assert got[d]["size"] == len((text or "").split())
    want = targets(dict(sizes))
    taken = Counter()
    for d, _, source in rows:
        r = got[d]
        assert r["target"] == pytest.approx(want[source]) and r["source_size"] == sizes[source] and 0 <= r["copies"] <= 3
        taken[source] += r["size"] * r["copies"]
    for source, size in sizes.items():
        if size > 1000:
            assert abs(taken[source] - want[source]) < 0.15 * want[source] + 100
    copies = Counter(r["doc_id"] for r in emit(mixed).collect())
    assert copies == Counter({d: r["copies"] for d, r in got.items() if r["copies"]})
    assert emit(mixed).columns == df.columns


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", None, 1), (None, "a b", None, 1), (3, None, "x", 2)], "doc_id long, text string, source string, size int")
    rows = mix(df).collect()
    assert len(rows) == 3 and {r["size"] for r in rows} == {0, 2}
    assert [r["copies"] for r in rows if r["size"]] == [1, 1]
    assert mix(df.limit(0)).count() == 0
