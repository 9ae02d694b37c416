import base64
import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from hushframe.llm.byte_bpe import ByteBpe, decode, encode, read_ranks, round_trip, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    draw = random.Random(5)
    yield from ("", " ", "\n\n  a", "aaaa" * 900, "<|endoftext|> it's", "ß" * 70 + "日本語テキスト", "\x1c\x85　 ​ x", "The the.\tThe\r\n")
    letters = "abcdefghijklmnopqrstuvwxyzéüñß'.,;%$|0123456789 \n\t日😀"
    for size in (1, 2, 3, 17, 64, 65, 300, 5000):
        for _ in range(15):
            yield "".join(draw.choices(letters, k=size))
    yield "".join(draw.choices("abc", k=20_000))


def test_ids_are_those_of_the_library(bpe, other):
    all_texts = list(texts())
    for text, ids in zip(all_texts, bpe.encode_batch(all_texts), strict=True):
        assert ids == other.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_every_character_of_the_lower_planes(bpe, other):
    for low in range(0, 0x30000, 0x400):
        if not 0xD800 <= low < 0xE000:
            text = " ".join(f"a{chr(c)}1{chr(c)}{chr(c)} " for c in range(low, low + 0x400))
            assert next(iter(bpe.encode_batch([text]))) == other.encode_ordinary(text)


def test_operators(spark, other):
    rows = [(1, "Hello there", "x"), (2, None, "y"), (3, "", "z"), (1, "Hello there", "x"), (None, "no id " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r["doc_id"], tuple(r["ids"])) for r in encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {(a, tuple(other.encode_ordinary(b or ""))) for a, b, _ in rows}
    back = decode(encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["data"]) for r in back) == sorted((b or "").encode() for _, b, _ in rows)
    digests = round_trip(docs, PATH, public_tokenizers.PATTERN).collect()
    assert len(digests) == 5
    for r in digests:
        text = next(b or "" for a, b, _ in rows if a == r["doc_id"])
        ids = other.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert round_trip(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("make", [encode, round_trip])
def test_a_task_leaves_no_pieces_in_its_worker(spark, make):
    class Worked:
        schema = spark.createDataFrame([(1, "")], "doc_id long, text string").schema

        def select(self, *columns):
            return self

        def mapInArrow(self, work, schema):  # noqa: N802
            return work

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["zqxv qvzx", ""])], ["doc_id", "text"])
    assert sum(part.num_rows for part in make(Worked(), PATH, public_tokenizers.PATTERN)(iter([batch]))) == 2
    own = tokenizer(PATH, public_tokenizers.PATTERN)
    assert not own.known and not own.older
