"""Alignment of the tokens of two tokenizers over the same bytes.

Tokens of both sides are ranges of bytes. Every token points to the farthest-right token of the other side that overlaps
it, the last one of a component to itself. Doubling the pointers (`to = to[to]`) takes all tokens of a batch to the
terminal token of their component at once, in as many steps as the longest component has doublings; the terminal labels
the group. Group borders are the offsets at which tokens of both sides end.

Both tokenizers end a token before a single space between two other characters (A splits there by its pattern; no piece
of B continues behind a space mark that follows something else, which is checked when it is loaded). So texts are cut
into chunks there, and each distinct chunk that a worker meets is tokenized and aligned once.

Counts of linked id pairs over all documents come from a sum over the rows; the most frequent pairs, a bounded number, are
broadcast to the links, the others meet them in a shuffle.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.byte_bpe import rows_field, slices
from hushframe.llm.common import text_or_empty
from hushframe.storage import written

#: Pairs that are broadcast; the other ones of more are joined by a shuffle.
BROADCAST_PAIRS = 500_000
#: About as many bytes of what is known of chunks a worker keeps; then it keeps the frequent ones.
STORE_BYTES = 128 << 20
#: Chunks that came so often are still known then.
OFTEN = 4
#: Bytes of texts that are aligned at once.
SLICE_BYTES = 1 << 20
# How the pieces of B spell spaces and single bytes.
SPACE_MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


def pointers(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Where each token points: tokens of A are numbered first, those of B after them; both cover the same bytes.

    A token ends at `ends`, and starts where the one before it ends. The token that holds a token's last byte is the
    farthest-right one that overlaps it. If both end together, the one of A is the terminal of the component.
    """
    over = np.searchsorted(ends_b, ends_a)
    to_b = np.where(ends_b[over] > ends_a, over + len(ends_a), np.arange(len(ends_a)))
    return np.concatenate([to_b, np.searchsorted(ends_a, ends_b)])


def terminals(to: np.ndarray) -> np.ndarray:
    """The terminal that each token reaches, by doubling of all pointers."""
    while True:
        farther = to[to]
        if (farther == to).all():
            return to
        to = farther


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of A, token of B) of all pairs that overlap, in order."""
    starts_a = np.append(0, ends_a[:-1])
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a)
    count = last - first + 1
    a = np.repeat(np.arange(len(ends_a)), count)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(count) - count - first, count)


class _Store:
    """What is known of chunks, by number: the groups as text, a row of counts, and the linked pairs, one after the other.

    A row counts the tokens of A and B, the groups, the links, and 1 if the tokens do not spell the chunk.
    """

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)
        self.first = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.weight = 0

    def add(self, chunks: list[str], groups: list[str], counts: np.ndarray, pairs: np.ndarray) -> None:
        self.number.update(zip(chunks, range(len(self.groups), len(self.groups) + len(chunks)), strict=True))
        self.groups += groups
        self.counts = np.concatenate([self.counts, counts])
        self.first = np.concatenate([self.first, len(self.pairs) + np.cumsum(counts[:, 3]) - counts[:, 3]])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.used = np.concatenate([self.used, np.zeros(len(chunks), np.int64)])
        self.weight += 350 * len(chunks) + 2 * sum(map(len, chunks)) + sum(map(len, groups)) + pairs.nbytes

    def linked(self, own: np.ndarray) -> np.ndarray:
        """The pairs of some chunks."""
        count = self.counts[own, 3]
        ends = np.cumsum(count)
        return self.pairs[np.repeat(self.first[own] - ends + count, count) + np.arange(int(ends[-1]))]

    def renewed(self) -> _Store:
        """A store with the chunks that came often; with none if even they are too many."""
        kept, chunks = np.flatnonzero(self.used >= OFTEN), list(self.number)
        new = _Store()
        if len(kept):
            new.add([chunks[k] for k in kept], [self.groups[k] for k in kept], self.counts[kept], self.linked(kept))
        return new if new.weight < STORE_BYTES // 2 else _Store()


class Aligner:
    """Two tokenizers, by their files."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters, added = _byte_letters(), {t.content for t in self.a.get_added_tokens_decoder().values()}
        spell = lambda token: token.encode() if token in added else bytes(letters[c] for c in token)
        self.bytes_a = [b""] * (max(self.a.get_vocab().values(), default=0) + 1)
        for token, number in self.a.get_vocab().items():
            self.bytes_a[number] = spell(token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(SPACE_MARK, " ").encode() for p in pieces]
        # Chunks are cut only if no piece goes on behind a space mark that follows another character.
        self.cut = re.compile(r"(?<=\S) (?=\S)" if not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces) else r"(?!)")
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.width = len(pieces)
        # Ids with what follows them in the text of the groups.
        self.names_a = np.array([f"{k}{c}" for c in ",|" for k in range(len(self.bytes_a))], object)
        self.names_b = np.array([f"{k}{c}" for c in ",;" for k in range(self.width)], object)
        self.store = _Store()

    def tokens(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of a space and each chunk."""
        ids_a = [e.ids for e in self.a.encode_batch_fast([f" {c}" for c in chunks], add_special_tokens=False)]
        return ids_a, self.b.encode(chunks, num_threads=1)

    def _spelled(self, chunks: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """Whether the tokens of both sides spell a space and the chunk: asked for all at once, and for each if some do not."""
        whole = [f" {c}".encode() for c in chunks]
        sides = ((self.bytes_a, ids_a), (self.bytes_b, ids_b))
        for spell, ids in sides:
            joined = [b"".join(map(spell.__getitem__, own)) for own in ids]
            if joined != whole:
                break
        else:
            return [True] * len(whole)
        return [all(b"".join(map(spell.__getitem__, ids[k])) == w for spell, ids in sides) for k, w in enumerate(whole)]

    def align(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of all chunks at once: the groups of each as text, a row of counts for each, and the linked pairs in order."""
        ids_a, ids_b = self.tokens(chunks)
        fits = self._spelled(chunks, ids_a, ids_b)
        for k, ok in enumerate(fits):
            if not ok:
                ids_a[k], ids_b[k] = [], []
        count_a, count_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        first_a, first_b = np.append(0, np.cumsum(count_a)), np.append(0, np.cumsum(count_b))
        odd = ~np.array(fits, bool)
        if not len(a):
            zero = np.zeros(len(chunks), np.int64)
            return [""] * len(chunks), np.column_stack([zero, zero, zero, zero, odd]), zero[:0]
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        top = terminals(pointers(ends_a, ends_b))
        label_a, label_b = top[: len(a)], top[len(a) :]
        # A component's last token of each side is followed by the end of the side or of the group.
        last_a, last_b = np.append(label_a[1:] != label_a[:-1], True), np.append(label_b[1:] != label_b[:-1], True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = self.names_a[a + last_a * len(self.bytes_a)]
        text[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = self.names_b[b + last_b * self.width]
        link_a, link_b = links(ends_a, ends_b)
        groups = np.diff(np.append(group_a, group_a[-1] + 1)[first_a])
        counts = np.column_stack([count_a, count_b, groups, np.diff(np.searchsorted(link_a, first_a)), odd])
        parts, cuts = text.tolist(), (first_a + first_b).tolist()
        said = ["".join(parts[x:y])[:-1] for x, y in zip(cuts, cuts[1:], strict=False)]
        return said, counts, a[link_a] * self.width + b[link_b]

    def texts(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, np.ndarray, np.ndarray]]:
        """(counts, groups, distinct pairs, how often each) of each text; counts of tokens of A and B, groups and links."""
        if self.store.weight > STORE_BYTES:
            self.store = self.store.renewed()
        store = self.store
        cut = [self.cut.split(text) if text else [] for text in texts]
        new = list(dict.fromkeys(c for c in chain.from_iterable(cut) if c not in store.number))
        if new:
            store.add(new, *self.align(new))
        numbers = np.fromiter(map(store.number.__getitem__, chain.from_iterable(cut)), np.int64)
        store.used += np.bincount(numbers, minlength=len(store.used))
        start = 0
        for text, chunks in zip(texts, cut, strict=True):
            own = numbers[start : start + len(chunks)]
            start += len(chunks)
            counts = store.counts[own].sum(0).tolist()
            if not chunks:
                said, pairs = "", _NONE
            elif not counts[4]:
                said, pairs = ";".join(map(store.groups.__getitem__, own.tolist())), store.linked(own)
            else:
                # Some chunk is not spelled by its tokens: the text as a whole decides.
                (said,), (counts,), pairs = self.align([text])
            yield [int(c) for c in counts[:4]], said, *np.unique(pairs, return_counts=True)


_NONE = np.zeros(0, np.int64)
_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The two tokenizers, loaded once in each worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Aligner(path_a, path_b)
    return _loaded[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, links) of each row.

    Side A is a file of the tokenizers library and encodes a space and the text, side B one of sentencepiece, which adds
    the space itself; both must be at their paths on every executor. `groups` is `a1,a2|b1;a3|b2`, the ids of both sides
    group by group, or with `digest` the SHA-256 of that. `links` holds the distinct (pair, often) of overlapping tokens;
    a pair is the id of A times the size of B, plus the id of B. `row` is a number that no other row has. A null or empty
    text has no tokens, and nor has one that the tokens of a side do not spell byte by byte (`groups` is empty then,
    digest or not). Repeated rows give repeated results; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    link = pa.struct([("pair", pa.int64()), ("often", pa.int64())])
    names = ["n_a", "n_b", "n_groups", "n_links"]
    schema = pa.schema([("row", pa.int64()), rows_field(rows), *[(n, pa.int64()) for n in names], ("groups", pa.string()), ("links", pa.list_(link))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                counts, groups, pairs, often = zip(*both.texts(part.column("text").to_pylist()), strict=True)
                if digest:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                cuts = np.append(0, np.cumsum([*map(len, pairs)]))
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (pairs, often)], ["pair", "often"])
                columns = [
                    pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id").cast(schema.field("doc_id").type),
                    *[pa.array(c, pa.int64()) for c in zip(*counts, strict=True)], pa.array(groups, pa.string()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat).cast(pa.list_(link)),
                ]
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, {', '.join(f'{n} long' for n in names)}, groups string, links array<struct<pair:long,often:long>>")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many links of all rows hold the pair, and whether no pair of the same id of B has more."""
    counts = written(aligned.select(F.inline("links")).groupBy("pair").agg(F.sum("often").alias("n")), "pair-counts")
    most = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("pair") % width == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of the rows that have links: links with a best pair, and the sum of the counts over links.

    Pairs of at least so many links that at most `broadcast_pairs` have them are broadcast: a hot pair is never the key of a
    shuffle. Rarer ones, if there are any, meet their links in one.
    """
    level = F.floor(F.log2("n"))
    sizes = {r["level"]: r["pairs"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).collect()}
    least, total = 64, 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > broadcast_pairs:
            break
        least = k
    frequent = F.broadcast(counts.filter(level >= least))
    single = aligned.select("row", F.inline("links"))
    met = single.join(frequent, "pair")
    if total > broadcast_pairs:
        met = met.unionByName(single.join(frequent, "pair", "left_anti").join(counts.filter(level < least), "pair"))
    return met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("n_best"), F.sum(F.col("often") * F.col("n")).alias("count_sum")
    )


def align_and_score(
    docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", digest: bool = False, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """The columns of `align` but for `row` and `links`, with `n_best` and `count_sum`; zeros for rows without links."""
    aligned = written(align(docs, path_a, path_b, doc_id, text, digest), "aligned")
    counts = written(pair_counts(aligned, aligner(path_a, path_b).width), "pairs")
    scores = score_links(aligned, counts, broadcast_pairs)
    joined = aligned.drop("links").join(scores, "row", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups",
    )
