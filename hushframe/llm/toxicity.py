"""Toxicity: a linear classifier on character n-grams, whose features are scaled by naive Bayes log-count ratios.

Fitting: documents of a bounded labelled sample give, for each hashed n-gram, the number of documents of either class
that have it. The log ratio of the smoothed shares scales the feature; the n-grams that tell the classes apart best are
kept, and a logistic regression on the scaled features is fitted by Spark. Scoring reads each whole text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.byte_bpe import slices
from hushframe.llm.common import text_or_empty
from hushframe.llm.labelled import labelled_sample

ORDERS = (3, 4, 5)
#: Hashed n-grams share so many counters.
BUCKETS = 1 << 22
#: Counters that travel in one row.
BLOCK = 1 << 14
#: At most so many n-grams become features: bounds what is sent to the driver and to every task.
FEATURES = 1 << 13
#: About so many labelled documents of each class are fitted on.
PER_CLASS = 6000
LEAST_Z = 3.0
STRENGTH = 1e-3


@dataclass(frozen=True)
class Model:
    """Weights of the chosen counters (log ratio times coefficient), and the intercept."""

    chosen: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    intercept: float


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The text number and the counter of each n-gram of each text, repeats included."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le"), np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.zeros(0, np.uint64)
    flat[(flat >= 9) & (flat <= 13)] = 32
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
    owners, counters = [], []
    with np.errstate(over="ignore"):
        for order in ORDERS:
            if len(flat) < order:
                continue
            n = len(flat) - order + 1
            value = np.full(n, np.uint64(order))
            for k in range(order):
                value = value * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + n]
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            inside = left[:n] >= order
            owners.append(owner[:n][inside])
            counters.append((value[inside] >> np.uint64(42)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(counters)


def _distinct(owners: np.ndarray, values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(owners * width + values)
    return pairs // width, pairs % width


def _counter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per counter and class of a task, in blocks."""
    counts = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        for part in slices(batch, "text"):
            labels = part.column("label").to_numpy(zero_copy_only=False)
            owners, counters = _distinct(*_grams(part.column("text").to_pylist()), BUCKETS)
            for label in (0, 1):
                counts[label] += np.bincount(counters[labels[owners] == label], minlength=BUCKETS).astype(np.int32)
    for block in range(BUCKETS // BLOCK):
        piece = np.ascontiguousarray(counts[:, block * BLOCK : (block + 1) * BLOCK])
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([piece.tobytes()], pa.binary())})


def _features(totals: dict[int, int]):  # noqa: ANN202
    """A function that sums blocks, sorted by block, and gives the counters that tell the classes apart."""
    n0, n1 = totals[0], totals[1]

    def rows(block: int, counts: np.ndarray) -> pa.RecordBatch:
        c0, c1 = counts.reshape(2, BLOCK).astype(np.float64)
        share0, share1 = (c0 + 1) / (n0 + 2), (c1 + 1) / (n1 + 2)
        both = (c0 + c1 + 2) / (n0 + n1 + 4)
        z = np.abs(share1 - share0) / np.sqrt(both * (1 - both) * (1 / (n0 + 2) + 1 / (n1 + 2)))
        at = np.flatnonzero(z >= LEAST_Z)
        ratio = np.log(share1[at] / share0[at])
        return pa.RecordBatch.from_pydict({"counter": pa.array(at + block * BLOCK, pa.int64()), "ratio": pa.array(ratio), "z": pa.array(z[at])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = -1, np.zeros(0, np.int64)
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if block != current:
                    if current >= 0:
                        yield rows(current, total)
                    current, total = block, np.zeros(2 * BLOCK, np.int64)
                total = total + np.frombuffer(data, np.int32)
        if current >= 0:
            yield rows(current, total)

    return run


def _index(chosen: np.ndarray) -> np.ndarray:
    index = np.full(BUCKETS, -1, np.int32)
    index[chosen] = np.arange(len(chosen), dtype=np.int32)
    return index


def _hits(texts: list[str], index: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The (text number, feature) pairs of some texts, each once."""
    owners, counters = _grams(texts)
    features = index[counters]
    found = features >= 0
    return _distinct(owners[found], features[found].astype(np.int64), max(width, 1))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", divisor: int = 5, fold: int = 0, per_class: int = PER_CLASS) -> Model:
    """Fit on about `per_class` documents of each class, none of them held out.

    If the labels hold one class only, or none, the model has no features and its intercept is the smoothed share of
    label 1.
    """
    sample = labelled_sample(docs, labels, label, divisor, fold, per_class)
    totals = {0: 0, 1: 0} | {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    nothing = np.zeros(0)
    if not totals[0] or not totals[1]:
        return Model(nothing.astype(np.int64), nothing, nothing, float(np.log((totals[1] + 1) / (totals[0] + 1))))
    blocks = sample.mapInArrow(_counter_rows, "block int, counts binary").repartition("block").sortWithinPartitions("block")
    features = blocks.mapInArrow(_features(totals), "counter long, ratio double, z double")
    best = features.orderBy(F.desc("z"), "counter").limit(FEATURES).select("counter", "ratio").collect()
    if not best:
        return Model(nothing.astype(np.int64), nothing, nothing, float(np.log((totals[1] + 1) / (totals[0] + 1))))
    best.sort()
    chosen, ratios = np.array([r["counter"] for r in best], np.int64), np.array([r["ratio"] for r in best])
    width = len(chosen)

    def own_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(chosen)
        for batch in batches:
            for part in slices(batch, "text"):
                owners, found = _hits(part.column("text").to_pylist(), index, width)
                cuts = np.searchsorted(owners, np.arange(part.num_rows + 1))
                own = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(found, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("label").cast(pa.float64()), own], ["label", "found"])

    vector = F.udf(lambda found: Vectors.sparse(width, found, ratios[found]), VectorUDT())
    rows = sample.mapInArrow(own_features, "label double, found array<int>").select(
        "label", vector("found").alias("features"),
        # Both classes weigh the same, however many documents of them there are.
        F.when(F.col("label") == 1, 0.5 / totals[1]).otherwise(0.5 / totals[0]).alias("weight"),
    )
    fitted = LogisticRegression(regParam=STRENGTH, maxIter=60, standardization=False, weightCol="weight").fit(rows)
    return Model(chosen, ratios, ratios * fitted.coefficients.toArray(), float(fitted.intercept))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row: the probability of label 1. A null or empty text gets that of the intercept alone.

    Only the text decides the score; repeated rows have the same one.
    """
    from hushframe.llm.byte_bpe import rows_field

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = pa.schema([rows_field(rows), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, width = _index(model.chosen), len(model.chosen)
        for batch in batches:
            for part in slices(batch, "text"):
                owners, found = _hits(part.column("text").to_pylist(), index, width)
                margin = np.bincount(owners, model.weights[found], part.num_rows) + model.intercept
                values = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(schema.field(0).type), pa.array(values)], schema=schema)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
