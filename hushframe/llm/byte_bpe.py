"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

A segment tree over the byte positions of a piece stores the leftmost minimum pair rank. A merge updates the points of
the merged pair and its live neighbours, so a piece of n bytes takes O(n log n) steps, however long it is. The trees
of many pieces are rows of one array and advance together; each distinct piece of a task's recent texts is encoded once.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import text_or_empty

#: Pieces in one array of trees, times their length: bounds the memory of a step.
CELLS = 1 << 21
#: Distinct pieces that a task remembers; older ones are forgotten.
REMEMBERED = 1 << 18
NO_PAIR = np.int64(1) << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBpe:
    """The merges of a vocabulary. Token ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern)
        self.width = max(ranks.values(), default=0) + 1
        self.tokens: list[bytes] = [b""] * self.width
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [str(rank) for rank in range(self.width)]
        self.whole = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.width + right] = rank
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        # One more key at the end, so that every search ends inside the array.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], NO_PAIR)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def _merge_rows(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Encode pieces of about the same length, one tree in each row."""
        count, longest = len(pieces), max(map(len, pieces))
        leaves = 1 << max(1, (longest - 1).bit_length())
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        row = np.repeat(np.arange(count), lengths)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        ids = np.full((count, leaves), -1, np.int64)
        ids[row, column] = flat
        live = ids >= 0
        after = np.broadcast_to(np.arange(1, leaves + 1), (count, leaves)).copy()
        before = np.broadcast_to(np.arange(-1, leaves - 1), (count, leaves)).copy()
        # A node holds rank * leaves + position: its minimum is the leftmost pair of the lowest rank.
        tree = np.full((count, 2 * leaves), NO_PAIR, np.int64)
        both = live[:, 1:].nonzero()
        ranks = self._rank(ids[both], ids[both[0], both[1] + 1])
        found = ranks < NO_PAIR
        tree[both[0][found], leaves + both[1][found]] = ranks[found] * leaves + both[1][found]
        size = leaves
        while size > 1:
            size //= 2
            tree[:, size : 2 * size] = np.minimum(tree[:, 2 * size : 4 * size : 2], tree[:, 2 * size + 1 : 4 * size : 2])
        rows = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(rows):
            root = tree[rows, 1]
            at = root % leaves
            gone = after[rows, at]
            follows = after[rows, gone]
            ids[rows, at] = root // leaves
            live[rows, gone] = False
            after[rows, at] = follows
            inside = follows < leaves
            before[rows[inside], follows[inside]] = at[inside]
            left = before[rows, at]
            self._update(tree, rows, gone, np.full(len(rows), NO_PAIR), leaves)
            follows_live = inside & live[rows, np.minimum(follows, leaves - 1)]
            self._pair(tree, ids, rows, at, follows, follows_live, leaves)
            self._pair(tree, ids, rows[left >= 0], left[left >= 0], at[left >= 0], np.ones(int((left >= 0).sum()), bool), leaves)
            rows = rows[tree[rows, 1] < NO_PAIR]
        kept = ids[live].tolist()
        ends = np.cumsum(live.sum(1)).tolist()
        return [tuple(kept[start:end]) for start, end in zip([0, *ends], ends, strict=False)]

    def _pair(self, tree, ids, rows, left, right, valid, leaves) -> None:  # noqa: ANN001
        """Set the leaf of the pair that begins at `left`; without a right neighbour it has no rank."""
        value = np.full(len(rows), NO_PAIR)
        ok = np.flatnonzero(valid)
        rank = self._rank(ids[rows[ok], left[ok]], ids[rows[ok], right[ok]])
        value[ok] = np.where(rank < NO_PAIR, rank * leaves + left[ok], NO_PAIR)
        self._update(tree, rows, left, value, leaves)

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, leaves: int) -> None:
        node = at + leaves
        tree[rows, node] = value
        while leaves > 1:
            leaves //= 2
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def _encode_pieces(self, pieces: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        raw = sorted(((len(data), data, piece) for piece in pieces for data in (piece.encode(),)), key=lambda x: x[0])
        group: list[tuple[int, bytes, str]] = []
        for item in raw:
            rank = self.whole.get(item[1])
            if rank is not None:
                yield item[2], (rank,)
                continue
            wide = 1 << (item[0] - 1).bit_length()
            if group and ((len(group) + 1) * wide > CELLS or wide > 1 << (group[0][0] - 1).bit_length()):
                yield from zip((p for _, _, p in group), self._merge_rows([d for _, d, _ in group]), strict=True)
                group = []
            group.append(item)
        if group:
            yield from zip((p for _, _, p in group), self._merge_rows([d for _, d, _ in group]), strict=True)

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text. Special tokens have no meaning: their text is ordinary text."""
        split = self.split.findall
        pieces = [split(text) for text in texts]
        new = set(chain.from_iterable(pieces))
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        missing = []
        for piece in new:
            if piece not in self.known:
                ids = self.older.get(piece)
                if ids is None:
                    missing.append(piece)
                else:
                    self.known[piece] = ids
        self.known.update(self._encode_pieces(missing))
        known = self.known.__getitem__
        for own in pieces:
            yield list(chain.from_iterable(map(known, own)))

    def forget(self) -> None:
        """Let go of the pieces remembered: the worker may go on with other work, which needs the memory."""
        self.known, self.older = {}, {}

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def tokenizer(path: str, pattern: str) -> ByteBpe:
    """The tokenizer of a file, built once in each worker."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def slices(batch: pa.RecordBatch, column: str, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice has about `chars` bytes of text; one longer text is a slice of its own."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start, total = 0, 0
    for at, size in enumerate(sizes):
        if at > start and total + size > chars:
            yield batch.slice(start, at - start)
            start, total = at, 0
        total += size
    if batch.num_rows > start:
        yield batch.slice(start)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of each row: `ids` is an array of token ids.

    The vocabulary file must be at `path` on every executor. A null or empty text has an empty array. Rows are
    independent: repeated rows give repeated results, other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    schema = pa.schema([rows_field(rows), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = pa.array(bpe.encode_batch(part.column("text").to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(schema.field(0).type), ids], schema=schema)
        bpe.forget()

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def rows_field(rows: DataFrame) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field("doc_id", to_arrow_type(rows.schema["doc_id"].dataType))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data) from (doc_id, ids): `data` is the bytes that the ids stand for; null ids have none."""
    schema = pa.schema([rows_field(encoded), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            data = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(schema.field(0).type), pa.array(data, pa.binary())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what `encode` and `decode` give, in one pass.

    With `ids`, the array of ids comes as a last column.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    fields = [rows_field(rows), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if ids else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        name = bpe.names.__getitem__
        for batch in batches:
            for part in slices(batch, "text"):
                counts, ids_digests, decoded, kept = [], [], [], []
                for own in bpe.encode_batch(part.column("text").to_pylist()):
                    counts.append(len(own))
                    ids_digests.append(hashlib.sha256(" ".join(map(name, own)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(own)).hexdigest())
                    if ids:
                        kept.append(pa.array(own, pa.int32()))
                columns = [part.column("doc_id").cast(schema.field(0).type), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(decoded)]
                if ids:
                    cuts = pa.array([0, *accumulate(counts)], pa.int32())
                    columns.append(pa.ListArray.from_arrays(cuts, pa.concat_arrays(kept)))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
        bpe.forget()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
