import random

import pytest

from hushframe.llm import line_dedup
from hushframe.llm.line_dedup import dedup_lines
from tests.llm import brute


def model(docs, span=2, long_words=8):
    """Run by run, in the order of ids."""
    seen, out = set(), {}
    for d in sorted(docs):
        lines = (docs[d] or "").split("\n")
        real = [i for i, line in enumerate(lines) if brute.words(line)]
        gone = set()
        runs = [(real[k : k + span]) for k in range(len(real) - span + 1)] + [[i] for i in real if len(brute.words(lines[i])) >= long_words]
        for places in sorted(runs, key=lambda p: p[0]):
            name = (len(places), *(lines[i] for i in places))
            if name in seen:
                gone |= set(places)
            seen.add(name)
        out[d] = sorted(gone), docs[d] if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize(("span", "hot", "broadcast"), [(2, 1_000, 10), (3, 3, 10), (2, 3, 0)])
def test_runs_are_those_of_a_slow_search(spark, monkeypatch, span, hot, broadcast):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "BROADCAST_HOT", broadcast)
    draw = random.Random(span)
    lines = ["a", "b", "c", "d e", "f", "", "  ", " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(8)), "word " * 7]
    docs = {i: "\n".join(draw.choices(lines, [9, 9, 9, 9, 9, 3, 3, 1, 1, 2], k=draw.randint(1, 14))) for i in range(120)}
    docs |= {200: None, 201: "", 202: "\n\n", 203: "a", 204: "a\nb\na\nb\na\nb"}
    docs |= {300 + i: f"unique {i}\nother {i}" for i in range(20)}
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, removed string").repartition(5)
    rows = dedup_lines(df, span=span).collect()
    assert {r["row"]["doc_id"]: (r["removed"], r["text"]) for r in rows} == model(docs, span)


def test_odd_rows(spark):
    rows = [(None, "a\nb\nc"), (2, "a\nb\nc"), (2, "a\nb\nc"), (2, "x\na\nb"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["row"]["doc_id"] or -1), r["text"] or "") for r in dedup_lines(df).collect())
    assert got == [(-1, "a\nb\nc"), (2, ""), (2, ""), (2, "x"), (3, "")]
    assert dedup_lines(df.limit(0)).count() == 0


def test_a_line_of_eight_words_counts_alone(spark):
    line = "This one line of eight words is shared."
    rows = [(1, f"x\n{line}\ny"), (2, f"p\n{line}\nq"), (3, line), (4, line.replace("one ", "")), (5, line.replace("one ", ""))]
    got = {r["row"]["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "p\nq", 3: "", 4: rows[3][1], 5: rows[3][1]}
