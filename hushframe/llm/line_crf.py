"""Document quality from a linear-chain conditional random field over lines.

Each line with a word is good or bad. Its evidence is measured on the line and on its two neighbours; neighbouring labels
influence each other. Forward-backward gives the probability that a line is good, and the mean of these, weighted by the
length of the lines, is the quality of the document. Labels of documents serve as labels of their lines in training.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.byte_bpe import rows_field, slices
from hushframe.llm.common import RangeHashes, text_bytes, text_or_empty, word_spans
from hushframe.llm.labelled import labelled_sample

#: About so many labelled documents of each class, of at most so many lines each, are fitted on: together they bound
#: what the driver holds while it fits.
PER_CLASS = 3000
TRAIN_LINES = 64
STEPS = 250
RATE = 0.1
STRENGTH = 1e-3
# Classes of bytes that lines are measured by.
_SYMBOL, _DIGIT, _UPPER, _HIGH, _STOP, _BANG, _BAR = (1 << k for k in range(7))
_TABLE = np.zeros(256, np.uint8)
for _bytes, _bit in ((b"#*$%&<>@^~=_\\{}[]", _SYMBOL), (b"0123456789", _DIGIT), (bytes(range(65, 91)), _UPPER),
                     (bytes(range(128, 256)), _HIGH), (b".,;:?", _STOP), (b"!", _BANG), (b"|", _BAR)):
    for _byte in _bytes:
        _TABLE[_byte] |= _bit
CLASSES = (_SYMBOL, _DIGIT, _UPPER, _HIGH, _STOP, _BANG, _BAR)
MEASURES = len(CLASSES) + 9


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    links: np.ndarray  # score of (label of a line, label of the next)
    empty: float = 0.0


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[ends] - sums[starts]


def _again(owner: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True where the same value came before in the same document."""
    order = np.lexsort((np.arange(len(values)), values, owner))
    same = np.zeros(len(values), bool)
    same[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (values[order[1:]] == values[order[:-1]])
    return same


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document, the byte length and the features of each line that has a word."""
    flat, offsets = text_bytes(texts)
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3 * MEASURES + 2), np.float64)
    if not len(flat):
        return empty
    # Lines end at line feeds and at the end of a text.
    breaks = np.flatnonzero(flat == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(flat)]
    ends = np.append(starts[1:], len(flat))
    word_starts, word_ends = word_spans(flat, offsets)
    line_of = np.searchsorted(starts, word_starts, "right") - 1
    n_words = np.bincount(line_of, minlength=len(starts))
    kept = n_words > 0
    renumber = np.cumsum(kept) - 1
    line_of, starts, ends, n_words = renumber[line_of], starts[kept], ends[kept], n_words[kept]
    if not len(starts):
        return empty
    n = len(starts)
    doc = np.searchsorted(offsets, starts, "right") - 1
    length = (ends - starts).astype(np.float64)
    word_length = (word_ends - word_starts).astype(np.float64)
    hashes = RangeHashes(flat)
    word = hashes(word_starts, word_ends)
    word_doc = doc[line_of]
    per_line = lambda flags: np.bincount(line_of, flags, n) / n_words
    follows = np.zeros(len(word), bool)
    follows[1:] = (word[1:] == word[:-1]) & (line_of[1:] == line_of[:-1])
    triple = np.zeros(len(word), bool)
    if len(word) > 2:
        three = RangeHashes(word)(np.arange(len(word) - 2), np.arange(3, len(word) + 1))
        whole = word_doc[2:] == word_doc[:-2]
        triple[2:][whole] = _again(word_doc[2:][whole], three[whole])
    classes = _TABLE[flat]
    own = np.column_stack([
        *[_runs((classes & bit) != 0, starts, ends) / length for bit in CLASSES],
        np.log1p(n_words), np.bincount(line_of, word_length, n) / n_words / 10, per_line(word_length <= 3), per_line(word_length > 20),
        per_line(follows), per_line(triple), _again(doc, hashes(starts, ends)).astype(float),
        (classes[word_ends[np.cumsum(n_words) - 1] - 1] & (_STOP | _BANG)) != 0, n_words < 3,
    ])
    apart = doc[1:] != doc[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    first, last = np.append(True, apart), np.append(apart, True)
    before[first], after[last] = 0, 0
    return doc, length.astype(np.int64), np.column_stack([own, before, after, first, last])


def _padded(doc: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of documents of about the same number of lines: their numbers, and line indexes padded with -1."""
    lines = np.bincount(doc, minlength=count)
    first = np.cumsum(lines) - lines
    size = np.ceil(np.log2(np.maximum(lines, 1))).astype(int)
    for kind in np.unique(size[lines > 0]):
        own = np.flatnonzero((size == kind) & (lines > 0))
        step = np.arange(lines[own].max())
        yield own, np.where(step < lines[own][:, None], first[own][:, None] + step, -1)


def _logsum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(evidence: np.ndarray, links: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded rows: log partition, P(good) of each line, expected counts of the four links.

    `evidence` is the score of good for each line; bad has score 0.
    """
    rows, steps = at.shape
    real = at >= 0
    good = np.where(real, evidence[at], 0.0)
    forward, backward = np.zeros((steps, rows, 2)), np.zeros((steps, rows, 2))
    forward[0, :, 1] = good[:, 0]
    for t in range(1, steps):
        for b in (0, 1):
            new = _logsum(forward[t - 1, :, 0] + links[0, b], forward[t - 1, :, 1] + links[1, b]) + b * good[:, t]
            forward[t, :, b] = np.where(real[:, t], new, forward[t - 1, :, b])
    for t in range(steps - 2, -1, -1):
        for a in (0, 1):
            new = _logsum(links[a, 0] + backward[t + 1, :, 0], links[a, 1] + good[:, t + 1] + backward[t + 1, :, 1])
            backward[t, :, a] = np.where(real[:, t + 1], new, 0.0)
    log_z = _logsum(forward[-1, :, 0], forward[-1, :, 1])
    both = forward + backward
    p_good = 1 / (1 + np.exp(np.clip(both[:, :, 0] - both[:, :, 1], -500, 500))).T
    expected = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            part = forward[:-1, :, a] + links[a, b] + b * good.T[1:] + backward[1:, :, b] - log_z
            expected[a, b] = np.exp(part)[real.T[1:]].sum()
    return log_z, p_good, expected


def _fit(doc: np.ndarray, features: np.ndarray, label: np.ndarray) -> Model:
    """Full-batch gradient steps (with momentum and scaled steps) on the regularised likelihood of the label chains."""
    mean, spread = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([(features - mean) / spread, np.ones(len(features))])
    groups = list(_padded(doc, len(label)))
    lines = np.bincount(doc, minlength=len(label))
    # What the chains say themselves: documents are labelled as a whole, so only equal labels follow each other.
    seen = np.diag([(lines[label == y] - 1).clip(0).sum() for y in (0, 1)]).astype(float)
    target = label[doc].astype(float)
    theta = np.zeros(x.shape[1] + 4)
    moment, scale = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        weights, links = theta[:-4], theta[-4:].reshape(2, 2)
        evidence = x @ weights
        p, expected = np.zeros(len(x)), np.zeros((2, 2))
        for _, at in groups:
            _, p_good, counts = marginals(evidence, links, at)
            p[at[at >= 0]] = p_good[at >= 0]
            expected += counts
        gradient = np.concatenate([x.T @ (p - target), (expected - seen).ravel()]) / len(label) + STRENGTH * theta
        moment = 0.9 * moment + 0.1 * gradient
        scale = 0.99 * scale + 0.01 * gradient**2
        theta = theta - RATE * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
    return Model(mean, spread, theta[:-4], theta[-4:].reshape(2, 2))


def _doc_scores(texts: pa.Array, model: Model) -> np.ndarray:
    doc, length, features = line_features(texts)
    x = np.column_stack([(features - model.mean) / model.spread, np.ones(len(features))])
    evidence = x @ model.weights
    out = np.full(len(texts), model.empty)
    for own, at in _padded(doc, len(texts)):
        _, p_good, _ = marginals(evidence, model.links, at)
        weight = np.where(at >= 0, length[at], 0)
        out[own] = (p_good * weight).sum(1) / weight.sum(1)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", divisor: int = 4, fold: int = 2, per_class: int = PER_CLASS) -> Model | float:
    """Fit on about `per_class` documents of each class with at most `TRAIN_LINES` lines, none of them held out.

    Features are computed by Spark; the bounded sample of them (see the module's constants) is fitted on the driver.
    If the labels hold one class only, or none, the result is a constant: the smoothed share of label 1.
    """
    short = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) < TRAIN_LINES
    sample = labelled_sample(docs, labels, label, divisor, fold, per_class, short)
    schema = pa.schema([("label", pa.int32()), ("lines", pa.int32()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, _, features = line_features(part.column("text"))
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                rows = [features[a:b].astype(np.float32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = [part.column("label").cast(pa.int32()), pa.array(np.diff(cuts), pa.int32()), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    got = sorted(tuple(r) for r in sample.mapInArrow(run, "label int, lines int, features binary").filter("lines > 0").collect())
    y = np.array([r[0] for r in got], int)
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 2))
    features = np.frombuffer(b"".join(bytes(r[2]) for r in got), np.float32).reshape(-1, 3 * MEASURES + 2).astype(np.float64)
    return _fit(np.repeat(np.arange(len(y)), [r[1] for r in got]), features, y)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """(doc_id, score) of every row: the length-weighted probability that its lines are good.

    A null text, an empty one and one without words have score 0. Only the text decides; repeated rows score alike.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    schema = pa.schema([rows_field(rows), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text")
                values = np.full(len(texts), model) if isinstance(model, float) else _doc_scores(texts, model)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(schema.field(0).type), pa.array(np.clip(values, 0, 1))], schema=schema)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
