"""Small helpers that several operators of this package share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of one Arrow batch whose texts are worked on together.
SLICE = 256


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for an empty text. Splitting at a plain character is the fastest way."""
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " "), "")


def replacing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; input columns of the same name, whatever their case, give way to them."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{name.replace('`', '``')}`") for name in df.columns if name.lower() not in taken]
    return df.select(*kept, *[column.alias(name) for name, column in columns.items()])


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo `divisor`: decides which rows a model never sees."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % divisor


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = SLICE) -> DataFrame:
    """Apply `work` to slices of at most `rows` rows, so that memory follows the slice and not the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield work(batch.slice(start, rows))

    return df.mapInArrow(run, schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text starts (one entry more than texts).

    Nulls count as empty.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def is_space(flat: np.ndarray) -> np.ndarray:
    return (flat == 32) | ((flat >= 9) & (flat <= 13))


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the texts start and end; no word reaches from one text into the next."""
    space = is_space(flat)
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(flat))]
    cuts = cuts[~space[cuts - 1] & ~space[cuts]]
    return (np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))) if len(cuts) else (starts, ends)


_ODD = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, count: int) -> np.ndarray:
    """Powers of an odd multiplier, or of its inverse, modulo 2^64."""
    if len(_powers[kind]) < count:
        base = _ODD if kind == "up" else pow(_ODD, -1, 1 << 64)
        steps = np.full(max(count, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class RangeHashes:
    """Hashes of any ranges of an array of values, each in constant time, from prefix sums modulo 2^64."""

    def __init__(self, values: np.ndarray):
        with np.errstate(over="ignore"):
            terms = mixed(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * _power("up", len(values))
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.down = _power("down", len(values) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: Bytes that are hashed at once: for each of them there are several numbers of eight bytes.
HASH_BYTES = 1 << 18


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`RangeHashes(flat)(starts, ends)` of sorted spans, block by block: memory follows the block and not the text."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
        out[at:to] = RangeHashes(flat[low : ends[to - 1]])(starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
