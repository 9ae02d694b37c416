"""The pipeline against its steps written out over one small table."""

import hashlib
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from hushframe.llm.byte_bpe import read_ranks
from hushframe.llm.mixing import mix
from tests.llm import brute
from tests.llm.test_line_dedup import model as line_model
from tests.llm.test_mixing import targets

PROSE = [" ".join(f"the w{i}of{k}" for i in range(45)) + f" the of and {k}" for k in range(30)]


def table():
    rows = []
    for k, text in enumerate(PROSE):
        stops = " ".join(w if i % 4 else "the" for i, w in enumerate(text.split()))
        rows.append((k, stops, "en", f"src{k % 3}" if k % 7 else None, len(stops)))
    rows += [(100 + k, rows[k][1] + " end", "en", "src1", 0) for k in range(6)]
    rows += [(200, None, None, None, None), (201, "bad | " * 40, "en", "src1", 9), (202, "word " * 50, "en", "src0", 250)]
    rows += [(300, rows[10][1] + "\nshared line\nother line", "en", "src0", 0), (301, "shared line\nother line\n" + rows[11][1].replace("w", "v"), "en", "src2", 0)]
    return rows


def test_stages_follow_each_other(spark, tmp_path):
    rows = table()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, "")
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & {200, 201, 202} and ids >= {r[0] for r in rows if r[0] < 30}
    texts = {r[0]: r[1] for r in rows if r[0] in ids}
    cut = {d: t for d, (_, t) in line_model(texts).items() if t}
    cut_docs = corpus_pipeline.lines(spark, kept, "")
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut_docs.collect()} == {d: (t, len(t)) for d, t in cut.items()}
    sets = {d: brute.shingles(t, 5) for d, t in cut.items()}
    first = {d: min(e for e in sets if 100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e])) for d in sets}
    unique = {d for d in first if first[d] == d}
    assert len(unique) < len(first)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, cut_docs, "").collect()} == unique
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for d in unique:
        sizes[source[d]] += len(brute.words(cut[d]))
    left = corpus_pipeline.near_duplicates(spark, cut_docs, "")
    mixed = {r["row"]["doc_id"]: r for r in mix(left).collect()}
    want = targets(dict(sizes))
    assert all(abs(mixed[d]["target"] - want[source[d]]) < 1e-6 for d in unique)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    expected = Counter()
    for d in unique:
        tokens = other.encode_ordinary(cut[d])
        digest = hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()
        expected[d, len(tokens), digest, hashlib.sha256(cut[d].encode()).hexdigest(), tuple(tokens)] += mixed[d]["copies"]
    assert Counter((*tuple(r)[:-1], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == +expected
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "source mixing", "byte-level BPE"]


def test_rows_count_by_id_and_text(spark):
    base, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    third = " ".join(f"u{i}" for i in range(60))
    rows = [(0, base, 1), (0, base, 2), (None, base + " end", 3), (2, other, 4), (2, third, 5), (3, other + " end", 6), (None, "", 7), (None, None, 8), (9, "lone", 9)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, `a.b` int, source string")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(k[1] in (base, base + " end") for k in kept).count(True) == 1
    assert sum((k[1] or "").startswith("v0 ") for k in kept) == 1 and (2, third, 5, "s") in kept and (9, "lone", 9, "s") in kept
    assert sum(not k[1] for k in kept) == 1
    assert corpus_pipeline.quality(spark, docs, "").columns == docs.columns == corpus_pipeline.lines(spark, docs, "").columns == corpus_pipeline.mixing(spark, docs, "").columns
    unique = spark.createDataFrame([(*r, "s") for r in rows if r[2] in (1, 6, 9)], docs.schema)
    assert corpus_pipeline.near_duplicates(spark, unique, "").count() == 3
