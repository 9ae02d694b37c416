"""Whitening of embeddings onto their leading principal components, by spectrum slicing.

Entries are turned into integers first, so sums, the covariance and deviations are exact and do not depend on how the
rows are dealt out. Per task there is one partial matrix of the size of the dimension squared; partial matrices are
added up in a tree, and only their sum reaches the driver.

There, the pivots of the LDL^T factors of the shifted covariance tell how many eigenvalues lie above a shift (the law of
inertia; on tridiagonal form, where factors without row exchanges are stable, and for many shifts at once). Halving by
these counts isolates each leading eigenvalue; Rayleigh quotient iteration converges cubically from there; and the
counts certify the numbers: what was found as the k-th has k - 1 eigenvalues above its interval and k above the lower end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import replacing

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Larger entries are cut to this before the shift, so that sums over a batch stay inside 64 bits.
FARTHEST = 1 << 46
#: Rows that are multiplied at once, and partial matrices that one task adds up.
ROWS = 4096
FAN_IN = 64
#: Fixed-point digits of partial sums of whitened products: sums of integers have no order.
POINT = 30
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Fit:
    """What whitening needs of all rows: none of it is larger than the dimension squared."""

    n: int
    sums: tuple[int, ...]
    reach: int  # no entry is farther from the whole part of its mean
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # one column for each
    trace: float
    error: float = float("nan")

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)


def _entries(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer rows) of slices of a batch."""
    for start in range(0, batch.num_rows, ROWS):
        part = batch.slice(start, ROWS)
        flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore"):
            near = np.clip(np.floor(SCALE * flat), -FARTHEST, FARTHEST)
        yield part.column("vec_id"), near.astype(np.int64).reshape(-1, dimension) + SHIFT


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector is neither null nor holds null or non-finite entries."""
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.filter(F.col("vector").isNotNull() & ~odd)


def _totals(rows: DataFrame, dimension: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(rows, tasks that have rows, (sum, smallest, largest) of each dimension)."""
    names = ["at", "n", "total", "low", "high"]
    kinds = [pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * dimension, None, None
        for batch in batches:
            for _, x in _entries(batch, dimension):
                n += len(x)
                total = [t + s for t, s in zip(total, x.sum(0).tolist(), strict=True)]
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            columns = [range(dimension), [n] * dimension, map(Decimal, total), low, high]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    parts = rows.mapInArrow(run, "at int, n long, total decimal(38,0), low long, high long")
    out = parts.groupBy("at").agg(F.sum("n").alias("n"), F.count("*").alias("tasks"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = sorted(out.collect())
    if not found:
        return 0, 0, []
    return found[0]["n"], found[0]["tasks"], [(int(r["total"]), r["low"], r["high"]) for r in found]


def _summed(rows: DataFrame, tasks: int, shape: tuple[int, int], kind: type, product: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """The sum of the matrices that `product` makes of the batches: one for each task, then added up in a tree."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for part in product(batch):
                total += part
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["matrix"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for raw in batch.column("matrix"):
                total += np.frombuffer(raw.as_buffer(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["matrix"])

    sums = rows.mapInArrow(first, "matrix binary")
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        sums = sums.repartition(tasks).mapInArrow(add, "matrix binary")
    found = sums.collect()
    return sum((np.frombuffer(bytes(r["matrix"]), kind).reshape(shape) for r in found), np.zeros(shape, kind))


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a matrix that is similar to a symmetric one, by Householder reflections."""
    a = np.array(matrix, float)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            continue
        x[0] += size if x[0] >= 0 else -size
        x /= np.linalg.norm(x)
        inner = a[k + 1 :, k + 1 :]
        p = inner @ x
        p -= (x @ p) * x
        inner -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1, k] = a[k, k + 1] = -size if a[k + 1, k] >= 0 else size
        a[k + 2 :, k] = a[k, k + 2 :] = 0
    return np.diag(a).copy(), np.diag(a, 1).copy()


def counts_above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie above each shift: the positive pivots of the LDL^T factors."""
    largest = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)))
    least = max(EPS * EPS * largest, 1e-290)
    pivot = diagonal[0] - shifts
    pivot = np.where(np.abs(pivot) < least, -least, pivot)
    above = (pivot > 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        pivot = diagonal[k] - shifts - off[k - 1] ** 2 / pivot
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        above += pivot > 0
    return above


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling) of a symmetric matrix and a unit eigenvector for each, as columns.

    Eigenvalues that no double can tell apart share an interval; their vectors are a basis of the common subspace.
    """
    n = len(matrix)
    count = min(count, n)
    diagonal, off = tridiagonal(matrix)
    radius = np.zeros(n)
    radius[:-1] += np.abs(off)
    radius[1:] += np.abs(off)
    norm = max(float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0)), np.finfo(float).tiny)
    closest = 4 * EPS * norm
    low = np.full(count, float((diagonal - radius).min()) - closest)
    high = np.full(count, float((diagonal + radius).max()) + closest)
    number = np.arange(1, count + 1)

    def halve(rows: np.ndarray) -> None:
        middle = (low[rows] + high[rows]) / 2
        inside = counts_above(diagonal, off, middle) >= number[rows]
        low[rows], high[rows] = np.where(inside, middle, low[rows]), np.where(inside, high[rows], middle)

    def alone() -> np.ndarray:
        return counts_above(diagonal, off, low) - counts_above(diagonal, off, high) == 1

    rows = number - 1
    while len(rows):
        halve(rows)
        rows = np.flatnonzero(~alone() & (high - low > closest))
    single = alone()
    values, vectors = np.zeros(count), np.zeros((n, count))
    draw = np.random.default_rng(12)
    k = 0
    while k < count:
        if single[k]:
            values[k], vectors[:, k] = _iterated(matrix, k, low, high, halve, vectors[:, :k], draw, norm, closest)
            k += 1
            continue
        # A cluster: all numbers whose intervals overlap this one, up to the last that is wanted.
        end = k + 1
        while end < count and not single[end] and high[end] >= low[k] - closest:
            end += 1
        block = draw.standard_normal((n, end - k))
        for _ in range(4):
            block -= vectors[:, :k] @ (vectors[:, :k].T @ block)
            block = np.linalg.qr(_solved(matrix, (low[k] + high[k]) / 2 + closest, block))[0]
        block -= vectors[:, :k] @ (vectors[:, :k].T @ block)
        block = np.linalg.qr(block)[0]
        own = np.einsum("ij,ij->j", block, matrix @ block)
        order = np.argsort(-own, kind="stable")
        values[k:end], vectors[:, k:end] = own[order], block[:, order]
        k = end
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(count)])
    return values, vectors * signs


def _solved(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(matrix - shift)^-1 right; a shift that is an eigenvalue to the last digit moves by a digit."""
    step = 0.0
    while True:
        try:
            out = np.linalg.solve(matrix - (shift + step) * np.eye(len(matrix)), right)
            if np.isfinite(out).all():
                return out / np.abs(out).max()
        except np.linalg.LinAlgError:
            pass
        step = 2 * step or EPS * max(abs(shift), float(np.abs(matrix).max()), np.finfo(float).tiny)


def _iterated(matrix, k, low, high, halve, known, draw, norm, closest) -> tuple[float, np.ndarray]:  # noqa: ANN001
    """The eigenpair whose number is k + 1: the only one in its interval, which the result must lie in."""
    start = draw.standard_normal(len(matrix))
    while True:
        x = start - known @ (known.T @ start)
        middle = (low[k] + high[k]) / 2
        for _ in range(2):
            x = _solved(matrix, middle, x)
            x /= np.linalg.norm(x)
        value, best = middle, np.inf
        for _ in range(12):
            value = float(x @ matrix @ x)
            left = float(np.linalg.norm(matrix @ x - value * x))
            if left <= EPS * norm or left >= best / 2 and best < 1e-10 * norm:
                break
            best = min(best, left)
            x = _solved(matrix, value, x)
            x /= np.linalg.norm(x)
        if low[k] - closest <= value <= high[k] + closest and left <= 1e-10 * norm:
            x = x - known @ (known.T @ x)
            return value, x / np.linalg.norm(x)
        if high[k] - low[k] <= closest:
            raise ArithmeticError(f"no vector for eigenvalue {k + 1}")
        for _ in range(4):
            halve(np.array([k]))


def fit(rows: DataFrame, dimension: int, components: int = COMPONENTS) -> Fit | None:
    """The covariance of all rows and its leading eigenpairs; None without rows.

    Components whose variance is nil to double precision are left out: they can't be scaled to one.
    """
    n, tasks, totals = _totals(rows, dimension)
    if not n:
        return None
    base = np.array([total // n for total, _, _ in totals], np.int64)
    rest = [total % n for total, _, _ in totals]
    reach = max(max(high - b, b - low) for (_, low, high), b in zip(totals, base.tolist(), strict=True))
    # Products of whole numbers are exact in doubles up to 2^53, and sums of them in 64 bits.
    exact = reach * reach * ROWS < 1 << 53 and reach * reach * n < 1 << 62
    kind = np.int64 if exact else np.float64

    def product(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, x in _entries(batch, dimension):
            y = (x - base).astype(np.float64)
            yield (y.T @ y).astype(kind)

    squares = _summed(rows, tasks, (dimension, dimension), kind, product)
    covariance = np.empty((dimension, dimension))
    for i in range(dimension):
        if exact:
            covariance[i] = [(n * c - rest[i] * r) / (n * n) for c, r in zip(squares[i].tolist(), rest, strict=True)]
        else:
            covariance[i] = squares[i] / n - (rest[i] / n) * (np.array(rest, float) / n)
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, components)
    real = values > 10 * dimension * EPS * max(trace, 0.0)
    made = Fit(n, tuple(t for t, _, _ in totals), int(reach), values[real], vectors[:, real], trace)
    return Fit(**{**made.__dict__, "error": _identity_error(rows, made, tasks, dimension)})


def _whitener(made: Fit) -> Callable[[np.ndarray], np.ndarray]:
    base, mean, scaled = made.base, made.rest / made.n, made.vectors / np.sqrt(made.values)

    def white(x: np.ndarray) -> np.ndarray:
        """One dimension after the other: then a row's last digits do not depend on which rows come with it."""
        centred = (x - base) - mean
        out = np.zeros((len(x), scaled.shape[1]))
        for k, weights in enumerate(scaled):
            out += centred[:, k : k + 1] * weights
        return out

    return white


def _identity_error(rows: DataFrame, made: Fit, tasks: int, dimension: int) -> float:
    """The largest entry of the covariance of the whitened rows minus the identity, measured on all of them."""
    size = len(made.values)
    if not size:
        return 0.0
    whiten = _whitener(made)
    fixed = float(1 << POINT)

    def product(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, x in _entries(batch, dimension):
            white = whiten(x)
            # One more row for the sums, so that the covariance is centred.
            yield np.rint(np.vstack([white.T @ white, white.sum(0)]) * fixed).astype(np.int64)

    total = _summed(rows, tasks, (size + 1, size), np.int64, product) / fixed / made.n
    return float(np.abs(total[:size] - np.outer(total[size], total[size]) - np.eye(size)).max())


def whitened(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Rows without a vector or with null or non-finite entries are not used. The dimension is the length that most vectors
    have (of equally frequent ones the larger); vectors of another length cannot be projected and are left out, too.
    Entries beyond 2^40 count as 2^40. Components without variance do not come out, so a single row or equal rows give
    none; ids may be null or repeat, and each row counts. `deviation` has up to 38 digits, and is null beyond. Other
    columns are not read. Equal eigenvalues have some orthonormal vectors of their subspace.
    """
    rows = usable(vectors, vec_id, vector)
    lengths = rows.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("size")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    kind = rows.schema["vec_id"].dataType
    schema = f"vec_id {kind.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    made = None
    if most:
        dimension = most[0]["size"]
        rows = rows.filter(F.size("vector") == dimension)
        made = fit(rows, dimension, components)
    if made is None or not len(made.values):
        return rows.sparkSession.createDataFrame([], schema)
    size, whiten, rest = len(made.values), _whitener(made), made.rest
    small = dimension * (made.n * (made.reach + 1)) ** 2 < 1 << 63
    explained = made.values / made.trace

    def deviations(x: np.ndarray) -> list[Decimal | None]:
        y = x - made.base
        if small:
            sums = ((made.n * y - rest) ** 2).sum(1).tolist()
        else:
            sums = [sum((made.n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True)) for row in y.tolist()]
        return [Decimal(s) if s < 10**38 else None for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _entries(batch, dimension):
                row = np.repeat(np.arange(len(x)), size)
                columns = [
                    ids.take(pa.array(row)), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(row), made.n)), pa.array(deviations(x), pa.decimal128(38, 0)).take(pa.array(row)),
                    pa.array(whiten(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(row), made.error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def with_long_deviation(made: DataFrame) -> DataFrame:
    """`deviation` as a long; null where it needs more digits."""
    return replacing(made, {"deviation": F.col("deviation").try_cast("long")}).select(*made.columns)
