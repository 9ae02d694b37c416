import random

from hushframe.llm.quality_rules import apply_rules
from tests.llm import brute


def repeat_words(text):
    w = brute.words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered |= set(range(i, i + 5))
    return len(covered)


def dup_lines(text):
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if brute.words(line):
            n += line in seen
            seen.add(line)
    return n


def test_counts_are_those_of_a_slow_count(spark):
    draw = random.Random(4)
    texts = [None, "", " \t\n", "a", "a b c d e a b c d e", "x " * 300, "the of\v\f\ra  b", "日本語 é | # $ <b>", " a  b c"]
    for _ in range(60):
        texts.append("".join(draw.choice(["the", "a", "b", "c", "of", "#", "x|", "\n", "\n\n", " ", "  ", "\t", "... "]) + draw.choice([" ", " ", "\n"]) for _ in range(draw.randint(1, 120))))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    rows = apply_rules(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        words = brute.words(text)
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == dup_lines(text)
        assert r["n_repeat_words"] == repeat_words(text)
        assert r["base_failed"] == (len(words) < 10 or 100 * repeat_words(text) > 20 * len(words))
        assert not (r["kept"] and r["base_failed"]) and r["kept"] == (not r["base_failed"] and not r["failed"])
    assert apply_rules(df.limit(0)).count() == 0


def test_verdicts(spark):
    clean = " ".join(f"the w{i} of" for i in range(40))
    texts = {1: clean, 2: clean.replace(" ", "%%% "), 3: " ".join(f"LOUD{i}!!" for i in range(80)), 4: "word " * 100, 5: "too short"}
    rows = apply_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == {1: True, 2: False, 3: False, 4: False, 5: False}
