import random

import pytest

from hushframe.llm import suffix_dedup
from hushframe.llm.suffix_dedup import LENGTH, dedup_suffixes


def brute(docs):
    """doc_id -> (bytes, spans, kept), window by window."""
    seen, out = set(), {}
    for d in sorted(docs):
        data = (docs[d] or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - LENGTH + 1):
            w = data[s : s + LENGTH]
            if w in seen:
                gone[s : s + LENGTH] = b"\1" * LENGTH
            seen.add(w)
        spans, start = [], None
        for i, g in enumerate([*gone, 0]):
            if g and start is None:
                start = i
            elif not g and start is not None:
                spans.append((start, i))
                start = None
        out[d] = len(data), spans, bytes(b for b, g in zip(data, gone, strict=True) if not g)
    return out


def texts(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdeéß日", k=draw.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (12, 18, 22, 30, 60, 200)]
    made = [None, "", "x", "ab" * 400, "Th " * 300, "=" * 99, "=" * 100, "=" * 101, "=" * 700]
    for _ in range(60):
        made.append(" ".join(draw.choice([prose(draw.randint(1, 30)), draw.choice(passages)]) for _ in range(draw.randint(1, 5))))
    for _ in range(25):
        base = draw.choice(made[9:])
        cut = draw.randrange(len(base))
        made.append(draw.choice([base, base[:cut] + "#" + base[cut:], base[cut:], base[:cut], base[cut:] + base[:cut]]))
    draw.shuffle(made)
    return dict(enumerate(made))


@pytest.mark.parametrize(("seed", "hot"), [(1, 50_000), (2, 3)])
def test_bytes_are_those_of_all_windows(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = texts(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: (r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in dedup_suffixes(df).collect()}
    assert got == brute(docs)


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, long, 1), (4, long, 2), (4, long, 2), (5, None, 3), (6, "x" + long, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long")
    got = sorted((r["doc_id"] or -1, len(r["kept"])) for r in dedup_suffixes(df).collect())
    assert got == [(-1, len(long)), (4, 0), (4, 0), (5, 0), (6, 1)]
    assert dedup_suffixes(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [50_000, 0])
@pytest.mark.parametrize("pieces", [1, 3])
def test_repeated_rows_that_hold_their_text_first_keep_it(spark, monkeypatch, hot, pieces):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    first, other = (" ".join(f"{w}{i}" for i in range(60)) for w in ("word", "term"))
    # The anchors of `mixed` have other contexts than those of `first`, so that the strings are induced, too.
    mixed = "y" + first[: len(first) // 2] + "#" + other
    docs = {4: first, 5: mixed, 6: "x" + first, 7: other}
    same = [(d, t) for d, t in docs.items() for _ in range(1 if d == 6 else 3)]
    parts = [spark.createDataFrame(same[k::pieces], "doc_id long, text string").coalesce(1) for k in range(pieces)]
    df = parts[0]
    for part in parts[1:]:
        df = df.union(part)
    want = brute(docs)
    got = sorted((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in dedup_suffixes(df).collect())
    assert got == sorted((d, *want[d]) for d, _ in same)
    assert len(want[4][2]) == len(first)
