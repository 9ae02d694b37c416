import functools
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from hushframe.llm.alignment import Aligner, align, align_and_score, links, pointers, terminals

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return Aligner(PATH_A, PATH_B)


@functools.cache
def side_bytes(tokenizer, model):
    """Token bytes, spelled out independently of the operator."""
    letters = {}
    nth = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters[chr(b)] = b
        else:
            letters[chr(256 + nth)] = b
            nth += 1
    a = {i: bytes(letters[c] for c in t) if t != "<|endoftext|>" else t.encode() for t, i in tokenizer.get_vocab().items()}
    b = {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        b[i] = bytes.fromhex(p[3:5]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    return a, b


def slow(both, text):
    """(ids A, ids B, groups as text, linked pairs) of a whole text, byte by byte; None if the bytes differ."""
    if not text:
        return None
    spell_a, spell_b = side_bytes(both.a, both.b)
    a = both.a.encode(" " + text, add_special_tokens=False).ids
    b = both.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(spell_a[i] for i in a) != whole or b"".join(spell_b[i] for i in b) != whole:
        return None
    own_a = [k for k, i in enumerate(a) for _ in spell_a[i]]
    own_b = [k for k, i in enumerate(b) for _ in spell_b[i]]
    linked = sorted({*zip(own_a, own_b, strict=True)})
    groups, start_a, start_b = [], 0, 0
    for at in range(len(whole)):
        if at + 1 == len(whole) or own_a[at] != own_a[at + 1] and own_b[at] != own_b[at + 1]:
            end_a, end_b = own_a[at] + 1, own_b[at] + 1
            groups.append(",".join(map(str, a[start_a:end_a])) + "|" + ",".join(map(str, b[start_b:end_b])))
            start_a, start_b = end_a, end_b
    return a, b, ";".join(groups), [(a[x], b[y]) for x, y in linked]


def texts():
    draw = random.Random(11)
    yield from ("a", " ", "  ", " a", "a ", "\n", "a\nb", "Hello world, it's 1234 o'clock.", "<|endoftext|> </s><s> <unk> <0x41> x", "▁ a▁b", "日本語のテキスト です", "a b   c", "x\x00y \x1c z", "é é ﬁ ①", "😀😀 👩‍👩‍👧", "word " * 300, "a" * 900, " \t ".join("abc"), "don't  won't\r\n\r\nI'll", "﻿a b", "ａ Ａ　b")
    letters = "abcdefghijklmnopqrstuvwxyzéüñßжш'.,;%$|<>0123456789    \n\t日😀▁ ́"
    for size in (1, 2, 3, 5, 17, 64, 400):
        for _ in range(25):
            yield "".join(draw.choices(letters, k=size))
    for _ in range(30):
        yield " ".join("".join(draw.choices("etaoin shrdlu,.'-" + "0123"[: draw.randint(0, 4)], k=draw.randint(1, 9))) for _ in range(60))


def test_chunks_give_what_whole_texts_give(both):
    all_texts = [None, "", *texts()]
    got = list(both.texts(all_texts))
    fits = 0
    for text, (counts, said, pairs, often) in zip(all_texts, got, strict=True):
        want = slow(both, text)
        if want is None:
            assert (counts, said, len(pairs)) == ([0, 0, 0, 0], "", 0), text
            continue
        fits += 1
        a, b, groups, linked = want
        assert said == groups, text
        assert counts == [len(a), len(b), groups.count(";") + 1, len(linked)]
        assert dict(zip(pairs.tolist(), often.tolist(), strict=True)) == Counter(x * both.width + y for x, y in linked)
    assert fits > 150 and fits < len(all_texts) - 3


def test_components_are_those_of_a_search():
    draw = random.Random(2)
    for _ in range(60):
        size = draw.randint(1, 60)
        a, b = (np.array(sorted({*draw.sample(range(1, size + 1), draw.randint(0, size - 1)), size})) for _ in range(2))
        both_end = sorted({*a.tolist()} & {*b.tolist()})
        label = lambda ends: [next(k for k, e in enumerate(both_end) if x <= e) for x in ends]
        top = terminals(pointers(a, b))
        assert [both_end.index(a[t]) for t in top] == label(a) + label(b)
        starts = lambda ends: [0, *ends[:-1].tolist()]
        want = [(i, j) for i, (s, e) in enumerate(zip(starts(a), a, strict=True)) for j, (u, v) in enumerate(zip(starts(b), b, strict=True)) if s < v and u < e]
        assert [*zip(*(x.tolist() for x in links(a, b)), strict=True)] == want


@pytest.mark.parametrize("broadcast_pairs", [500_000, 40, 0])
def test_counts_over_all_documents(spark, both, broadcast_pairs):
    rows = [(k, t) for k, t in enumerate(texts()) if k % 3 == 0] + [(900, None), (901, ""), (None, "Hello world"), (5, "again again"), (5, "again again")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, links string, row int").repartition(4)
    want, total = [], Counter()
    for i, t in rows:
        want.append((i, slow(both, t)))
        total.update(want[-1][1][3] if want[-1][1] else ())
    most = {}
    for (_, b), n in total.items():
        most[b] = max(n, most.get(b, 0))
    expected = Counter()
    for i, w in want:
        if w is None:
            expected[i, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            a, b, groups, linked = w
            best = sum(total[p] == most[p[1]] for p in linked)
            expected[i, len(a), len(b), groups.count(";") + 1, len(linked), best, sum(total[p] for p in linked), hashlib.sha256(groups.encode()).hexdigest()] += 1
    got = align_and_score(docs, PATH_A, PATH_B, digest=True, broadcast_pairs=broadcast_pairs)
    assert Counter(map(tuple, got.collect())) == expected


def test_real_groups_and_an_empty_table(spark, both):
    docs = spark.createDataFrame([(1, "Hello there friend")], "doc_id int, text string")
    r = align(docs, PATH_A, PATH_B).collect()[0]
    assert r["groups"] == slow(both, "Hello there friend")[2]
    assert sum(x["often"] for x in r["links"]) == r["n_links"]
    assert align_and_score(docs.filter("false"), PATH_A, PATH_B).collect() == []
