import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from hushframe.llm import common, window_dedup
from hushframe.llm.common import text_bytes, word_spans
from hushframe.llm.window_dedup import dedup_windows, windows_of
from tests.llm import brute


def model(rows, size):
    """Every window against every earlier one; rows with the same id and text are one document."""
    documents = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows})
    seen, gone = {}, {}
    for key in documents:
        words = brute.words(key[1])
        hit = set()
        for k in range(len(words) - size + 1):
            if seen.setdefault(tuple(words[k : k + size]), (key, k)) != (key, k):
                hit |= set(range(k, k + size))
        gone[key] = (len(words), sorted(hit), " ".join(w for k, w in enumerate(words) if k not in hit))
    return gone


def corpus():
    draw = random.Random(13)
    passages = [[draw.choice("abcdefgh") + str(draw.randint(0, 30)) for _ in range(n)] for n in (20, 21, 25, 60, 400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "z " * 19), (6, "z " * 90), (7, "x y " * 60), (8, "z " * 25)]
    for k in range(9, 60):
        parts = []
        for _ in range(draw.randint(1, 4)):
            parts += draw.choice(passages) if draw.random() < 0.6 else [f"w{draw.randint(0, 10**6)}" for _ in range(draw.randint(1, 50))]
        rows.append((k, draw.choice([" ", "\n", "\r\n ", "\t"]).join(parts)))
    rows += [(100, rows[20][1]), (101, rows[20][1].replace(" ", "  ")), (-5, rows[30][1]), (None, rows[40][1]), (None, "lone " * 30)]
    return rows + [rows[12], rows[12], rows[20]]


@pytest.mark.parametrize(("size", "gram", "hot"), [(20, 5, 50_000), (20, 5, 2), (6, 2, 50_000), (6, 6, 3), (1, 1, 50_000)])
def test_words_that_stay_are_those_of_all_windows_compared(spark, size, gram, hot):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, start int").repartition(5)
    want = model(rows, size)
    got = dedup_windows(docs, size=size, gram=gram, hot=hot).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, set()).add(want[-(2**63) if i is None else i, t or ""][2])
    for r in got:
        key = -(2**63) if r["doc_id"] is None else r["doc_id"]
        fits = [w for (i, _), w in want.items() if i == key and w[2] == r["kept"] and w[0] == r["n_words"]]
        assert fits, r
        assert [p for a, b in r["spans"] for p in range(a, b)] == fits[0][1]
        assert all(a[1] < b[0] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_small_batches_and_chunks_change_nothing(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(repr, dedup_windows(docs).collect()))
    monkeypatch.setattr(window_dedup, "CHUNK", 3)
    monkeypatch.setattr(window_dedup, "SLICE_BYTES", 300)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        assert sorted(map(repr, dedup_windows(docs.repartition(7)).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_an_empty_table_and_an_id_of_text(spark):
    assert dedup_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(7, "a b")], "key int, body string")
    assert [tuple(r) for r in dedup_windows(docs, "key", "body").collect()] == [(7, 2, [], "a b")]


def test_windows_of_a_packed_string():
    assert windows_of(b"a bb c d", 3) == [b"a bb c", b"bb c d"]
    assert windows_of(b"a", 1) == [b"a"]
    assert windows_of(b"a b", 3) == []


def test_memory_of_super_kmers_stays_near_that_of_the_words():
    draw = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{n}" for n in draw.integers(0, 10**6, 50_000)) for _ in range(10)])
    flat, offsets = text_bytes(texts)
    window_dedup.super_kmers(flat[: 1 << 16], np.array([0, 1 << 16]), 20, 5)
    tracemalloc.start()
    try:
        made = window_dedup.super_kmers(flat, offsets, 20, 5)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(made[0]) > 50_000
    # 4 MB of text are 500,000 words, and ten numbers of eight bytes for each byte of the text would be 310 MB.
    assert peak < 35 * len(flat)


@pytest.mark.parametrize("block", [1, 7, 50, 10**6])
def test_hashes_of_spans_do_not_depend_on_the_block(monkeypatch, block):
    flat = np.frombuffer(b"one two  three one a-word-longer-than-most two three", np.uint8)
    starts, ends = word_spans(flat, np.array([0, len(flat)]))
    monkeypatch.setattr(common, "HASH_BYTES", block)
    got = common.span_hashes(flat, starts, ends)
    assert got.tolist() == common.RangeHashes(flat)(starts, ends).tolist()
    assert common.span_hashes(flat, starts[:0], ends[:0]).tolist() == []
