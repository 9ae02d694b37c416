import math
from decimal import Decimal

import numpy as np
import pytest

from hushframe.llm.whitening import counts_above, leading, tridiagonal, whitened, with_long_deviation

SCHEMA = "vec_id long, embedding array<float>, component string, label int"


def matrices():
    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 20, 64):
        a = draw.standard_normal((3 * n, n))
        yield a.T @ a / (3 * n)
    yield np.eye(9)
    yield np.zeros((5, 5))
    yield np.diag([5.0, 5, 5, 1, 1, 0, -2])
    q = np.linalg.qr(draw.standard_normal((12, 12)))[0]
    yield q @ np.diag([9, 9, 9, 9, 4, 4, 1, 1 - 1e-13, 1e-9, 0, 0, 0]) @ q.T
    yield 1e12 * (np.ones((6, 6)) + 1e-6 * np.diag(range(6)))


@pytest.mark.parametrize("matrix", list(matrices()))
def test_eigenpairs_are_those_of_a_dense_solver(matrix):
    matrix = (matrix + matrix.T) / 2
    want = np.linalg.eigvalsh(matrix)[::-1]
    norm = max(np.abs(want).max(), 1e-300)
    diagonal, off = tridiagonal(matrix)
    assert np.allclose(np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))[::-1], want, atol=1e-13 * norm)
    gaps = (want[1:] + want[:-1]) / 2
    clear = (want[:-1] - want[1:]) > 1e-12 * norm
    assert (counts_above(diagonal, off, gaps[clear]) == np.arange(1, len(want))[clear]).all()
    values, vectors = leading(matrix, 32)
    assert np.allclose(values, want[:32], atol=1e-13 * norm)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * norm


def model(rows, components=32):
    """Whole numbers, Python's integers and a dense solver."""
    kept = [(i, v) for i, v in rows if v is not None and not any(c is None or not math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = np.array([[r[j] - sums[j] / n for j in range(d)] for r in x])
    v = np.array([[sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x) / n**3 for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    order = np.argsort(-e)[:components]
    return {
        "ids": [i for i, _ in kept], "deviation": [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x],
        "white": y @ q[:, order] / np.sqrt(e[order]), "explained": e[order] / np.trace(v), "n": n,
    }


@pytest.mark.parametrize(("n", "d", "offset"), [(300, 40, 0.0), (90, 6, -700.0), (50, 3, 1e6)])
def test_rows_are_those_of_a_slow_solver(spark, n, d, offset):
    draw = np.random.default_rng(d)
    scales = 1.3 ** -np.arange(d) * 8
    rows = [(k, [float(np.float32(c)) for c in draw.standard_normal(d) * scales + offset]) for k in range(n)]
    rows += [(900, None), (901, [None] * d), (902, [1.0] * (d - 1) + [float("nan")]), (903, [float("-inf")] + [0.0] * (d - 1)), (1, rows[0][1])]
    want = model(rows)
    docs = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], SCHEMA).repartition(7)
    got = with_long_deviation(whitened(docs)).collect()
    size = min(32, d)
    assert len(got) == want["n"] * size
    assert {r["n"] for r in got} == {want["n"]} and len({r["identity_error"] for r in got}) == 1
    assert 0 <= got[0]["identity_error"] < 1e-6
    table = {}
    for r in got:
        table.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    signs = None
    for at, (i, deviation) in enumerate(zip(want["ids"], want["deviation"], strict=True)):
        own = table[i, deviation]
        assert sorted(own) == list(range(1, size + 1))
        mine = np.array([own[c][0]["whitened"] for c in range(1, size + 1)])
        if signs is None:
            signs = np.sign(mine * want["white"][at])
        assert np.allclose(mine * signs, want["white"][at], atol=1e-8)
        assert np.allclose([own[c][0]["explained"] for c in range(1, size + 1)], want["explained"], rtol=1e-9)


def test_results_do_not_depend_on_the_partitions(spark):
    draw = np.random.default_rng(1)
    docs = spark.createDataFrame([(k, draw.standard_normal(10).tolist(), "", 0) for k in range(500)], SCHEMA)
    one, two = (sorted(map(tuple, whitened(docs.repartition(p)).drop("identity_error").collect())) for p in (1, 70))
    assert one == two


def test_odd_tables(spark):
    def rows(*vectors):
        return whitened(spark.createDataFrame([(k, v, None, None) for k, v in enumerate(vectors)], SCHEMA)).collect()

    assert rows() == [] and rows(None, []) == [] and rows([1.0, 2.0]) == []
    assert rows([1.0, 2.0], [1.0, 2.0], [1.0, 2.0]) == []
    # Only one direction has a variance; the vector of another length is left out.
    got = rows([0.0, 1.0], [1.0, 1.0], [2.0, 1.0], [5.0])
    assert [(r["vec_id"], r["component"], r["n"]) for r in sorted(got)] == [(0, 1, 3), (1, 1, 3), (2, 1, 3)]
    assert np.allclose(sorted(r["whitened"] for r in got), [-math.sqrt(1.5), 0, math.sqrt(1.5)])
    assert {r["deviation"] for r in got} == {Decimal(0), Decimal((3 * 64) ** 2)}
    huge = rows([3e38, 0.0], [-3e38, 1.0], [0.0, 2.0], [7.0, 2.5])
    assert {r["component"] for r in huge} <= {1, 2} and all(math.isfinite(r["whitened"]) for r in huge)
    nulls = whitened(spark.createDataFrame([(None, [0.0], "", 1), (None, [1.0], "", 1)], SCHEMA)).collect()
    assert [r["vec_id"] for r in nulls] == [None, None]
