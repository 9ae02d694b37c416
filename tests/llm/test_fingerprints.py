import hashlib
import random

from pyspark.sql import functions as F

from hushframe.llm import fingerprints
from hushframe.llm.fingerprints import GRAM, SPAN, chosen_positions, digest, edited_fingerprints, with_fingerprints


def winnow(hashes, span):
    """Rightmost minimum of every window, window by window."""
    span = min(span, len(hashes))
    chosen = set()
    for s in range(len(hashes) - span + 1) if hashes else ():
        low = min(hashes[s : s + span])
        chosen.add(max(i for i in range(s, s + span) if hashes[i] == low))
    return sorted(chosen)


def test_chosen_positions(spark):
    draw = random.Random(1)
    arrays = [[draw.randint(0, 5) for _ in range(n)] for n in (0, 1, 2, 5, 6, 7, 30, 80) for _ in range(8)]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, h array<long>")
    for span in (1, 2, 6):
        got = {r["i"]: r["p"] for r in df.select("i", chosen_positions(F.col("h"), span).alias("p")).collect()}
        assert [got[i] for i in range(len(arrays))] == [winnow(a, span) for a in arrays]


def test_shared_runs_share_a_fingerprint(spark):
    draw = random.Random(2)
    prose = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    shared = prose(GRAM + SPAN - 1)
    texts = [" ".join(prose(draw.randint(0, 40)) + shared + prose(draw.randint(0, 40))) for _ in range(12)]
    rows = with_fingerprints(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), ["text"]).collect()
    assert set.intersection(*[set(r["text_hashes"]) for r in rows])
    for r in rows:
        words = texts[r["i"]].split(" ")
        assert all(0 <= p <= len(words) - GRAM for p in r["text_positions"])


def model(docs):
    """doc_id -> edited text, in the order of ids."""
    order = sorted(docs)
    out = {}
    for k, d in enumerate(order):
        text, after = docs[d] or "", docs[order[(k + 1) % len(order)]] or ""
        q = len(text) // 4
        out[d] = text[: len(text) - q] + after[:q]
    return out


def test_edited_texts(spark, monkeypatch):
    draw = random.Random(3)
    docs = {draw.randrange(-(10**6), 10**12): "".join(draw.choices("ab é日\n", k=draw.choice([0, 1, 3, 4, 5, 50, 400]))) for _ in range(150)}
    docs[17] = None
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(7)
    for buckets in (1, 2, 9, 90):
        monkeypatch.setattr(fingerprints, "buckets_for", lambda _, n=buckets: n)
        rows = edited_fingerprints(df).collect()
        want = model(docs)
        assert {r["doc_id"]: r["edited_sha256"] for r in rows} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
        assert {r["doc_id"]: r["n_chars"] for r in rows} == {d: len(t or "") for d, t in docs.items()}
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, 1), (2, text, 2), (2, text, 3), (None, "x y", 4), (None, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hashes int")
    got = edited_fingerprints(df).select("*", digest(F.col("hashes"), F.col("positions")).alias("d")).collect()
    assert len(got) == 5
    same = [r for r in got if r["n_chars"] == len(text)]
    assert len({r["d"] for r in same}) == 1 and sorted(r["near_next"] for r in same) == [0.0, 1.0, 1.0]
    assert edited_fingerprints(df.limit(0)).count() == 0
