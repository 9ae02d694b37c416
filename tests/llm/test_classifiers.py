import random
import zlib

import numpy as np
import pytest

from hushframe.llm import line_crf, toxicity


def corpus(n, seed=0):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(2, 7)))
    docs, quality, toxic = {}, {}, {}
    for d in range(n):
        lines = [" ".join(word() for _ in range(draw.randint(4, 15))) + "." for _ in range(draw.randint(1, 6))]
        quality[d], toxic[d] = int(draw.random() < 0.6), int(draw.random() < 0.3)
        if not quality[d]:
            lines = [draw.choice([line.replace(" ", " | "), "$$$ ".join(line.split()), "same same " * 9]) for line in lines]
        if toxic[d]:
            lines.append(f"you {draw.choice(['zyxq', 'qzzt'])}{draw.choice(['', 'en', 's'])} {word()}")
        docs[d] = "\n".join(lines)
    return docs, quality, toxic


@pytest.fixture(scope="module")
def tables(spark):
    docs, quality, toxic = corpus(700)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, score string").repartition(4)
    return df, spark.createDataFrame([(d, quality[d], toxic[d]) for d in docs], "doc_id long, quality int, toxic int"), quality, toxic


ODD = [(None, "a b | c", 1), (1, None, 2), (2, "", 3), (3, " \n ", 4), (4, "x" * 30_000, 5), (4, "x" * 30_000, 5)]


@pytest.mark.parametrize(("model", "label", "divisor", "fold", "line"), [(line_crf, "quality", 4, 2, 0.7), (toxicity, "toxic", 5, 0, 0.5)])
def test_held_out_accuracy(spark, tables, model, label, divisor, fold, line):
    df, labels, quality, toxic = tables
    truth = quality if label == "quality" else toxic
    fitted = model.fit(df, labels)
    rows = model.score(df, fitted).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % divisor == fold]
    assert len(held) > 100 and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([(r["score"] >= line) == bool(truth[r["doc_id"]]) for r in held]) > 0.95
    odd = spark.createDataFrame(ODD, "doc_id long, text string, label int")
    scores = model.score(odd, fitted).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["doc_id"] == 4}) == 1
    assert model.score(odd.limit(0), fitted).count() == 0


@pytest.mark.parametrize("model", [line_crf, toxicity])
def test_labels_of_one_class_or_none(spark, tables, model):
    df, labels, _, _ = tables
    for kept in (labels.filter("quality = 1 and toxic = 1"), labels.limit(0)):
        assert all(0 < r["score"] < 1 for r in model.score(df.limit(5), model.fit(df, kept)).collect())


def test_marginals_are_those_of_all_labelings():
    draw = np.random.default_rng(1)
    evidence, links = draw.normal(size=9), draw.normal(size=(2, 2))
    at = np.array([[0, 1, 2, 3], [4, 5, -1, -1], [6, 7, 8, -1]])
    log_z, p, expected = line_crf.marginals(evidence, links, at)
    total = np.zeros((2, 2))
    for row, places in enumerate(at):
        real = places[places >= 0]
        weights = {}
        for code in range(2 ** len(real)):
            y = [(code >> k) & 1 for k in range(len(real))]
            weights[tuple(y)] = np.exp(sum(evidence[i] * v for i, v in zip(real, y, strict=True)) + sum(links[a, b] for a, b in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        assert log_z[row] == pytest.approx(np.log(z))
        for k in range(len(real)):
            assert p[row, k] == pytest.approx(sum(v for y, v in weights.items() if y[k]) / z)
        for y, v in weights.items():
            for a, b in zip(y, y[1:], strict=False):
                total[a, b] += v / z
    assert expected == pytest.approx(total)
