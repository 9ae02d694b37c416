import pytest
from pyspark.sql import functions as F

from hushframe.functions.masking import mask_email, mask_generic, mask_phone, mask_value
from hushframe.functions.sizes import format_size
from hushframe.functions.text import canonical_text, decode_utf8, line_count, lines_of, strip, word_count
from hushframe.operators import rules
from hushframe.operators.detect import detect_text
from hushframe.operators.profile_text import keywords_by_group, keywords_by_text, text_counts

TEXTS = [
    "", "\n", "a", "a\n", "a\n\n", "\r\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k", "a\x1fb", "\n\na\r", "č\r\r\n",
]


def one(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_lines_and_strip_as_python(spark):
    assert one(spark, TEXTS, lines_of) == [t.splitlines() for t in TEXTS]
    assert one(spark, TEXTS, line_count) == [len(t.splitlines()) for t in TEXTS]
    blanks = [" a ", "\u00a0a b\u3000", "\x1c\x1fa\x85", "\u200ba", "", " \t", "\u2003x\u2028"]
    assert one(spark, blanks, strip) == [b.strip() for b in blanks]


def test_numbers_as_python(spark):
    values = [0.0, -0.0, 1.0, 0.1, 123456789.0, 1e7, 9999999.5, 1e15, 1e16, 1.5e300, 1e-4, 0.000123456789, 1e-5, -2.5e-7,
              float("inf"), float("-inf"), 12345678.912345678]
    dtype = spark.createDataFrame([(1.0,)], "v double").schema["v"].dataType
    assert one(spark, values, lambda v: canonical_text(v, dtype), "double") == [str(v) for v in values]
    assert one(spark, [float("nan"), None], lambda v: canonical_text(v, dtype), "double") == [None, None]


def test_decode(spark):
    raw = [b"a\xffb\r\nc\rd\ne", "žluť".encode(), b"\xe2\x82", b""]
    want = [b.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n") for b in raw]
    assert one(spark, [bytearray(b) for b in raw], decode_utf8, "binary") == want


def test_words(spark):
    texts = ["Příliš žluťoučký_kůň 12 ²", "a-b c'd", "", "___"]
    assert one(spark, texts, word_count) == [4, 4, 0, 1]


def test_masks(spark):
    values = ["jan@example.com", "j@e.cz", "no mail", "ja@host", "x a@b.c tail. end", "a@@b.c"]
    assert one(spark, values, mask_email) == [
        "ja***@ex***.com", "***@***.cz", "***", "ja***@***", "x ***@***.c tail. end", "***@@b***.c",
    ]
    assert one(spark, ["see jan@example.com now"], lambda v: mask_email(v, rules.EMAIL)) == ["ja***@ex***.com"]
    assert one(spark, [" +1 23", "777", "none"], mask_phone) == ["+420 *** *** ***", "*** *** ***", "***"]
    assert one(spark, ["", "a", "ab", " abc ", "žluť"], mask_generic) == ["", "*", "**", "a***c", "ž***ť"]
    assert one(spark, [None, "abc"], lambda v: mask_value(v, F.lit("name"))) == ["", "a***c"]


def test_sizes(spark):
    values = [0, 1023, 1024, 1280, 1024**2 - 1, 1024**2, 5 * 1024**3, 3 * 1024**4]
    assert one(spark, values, format_size, "bigint") == [
        "0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "1024.0 KB", "1.0 MB", "5.0 GB", "3072.0 GB",
    ]


def found(spark, text, mode, as_of="2026-01-01"):
    df = spark.createDataFrame([(1, text)], "d int, text string")
    rows = detect_text(df, ["d"], "text", mode, as_of).orderBy("line_no", "match_no").collect()
    return [(r["line_no"], r["pii_type"], r["raw_value"]) for r in rows]


def test_text_rules(spark):
    assert found(spark, "Kontakt: jana@firma.cz\nDatum narozeni: 1988-05-17", "balanced") == [
        (1, "EMAIL", "jana@firma.cz"), (2, "DOB", "1988-05-17"),
    ]
    assert found(spark, "Vytvoreno: 2025-05-12", "balanced") == []
    # The match starts behind the plus sign; repeats are kept; no finding reaches over a line end.
    assert found(spark, "+420 777 888 999, 777888999\n777\n888\n999", "strict") == [
        (1, "PHONE", "420 777 888 999"), (1, "PHONE", "777888999"),
    ]
    assert found(spark, "8501010012 850101/1234", "balanced") == [
        (1, "PHONE", "8501010012"), (1, "RC", "8501010012"), (1, "BANK", "850101/1234"),
    ]
    assert found(spark, "850101/1234", "relaxed") == [(1, "RC", "850101/1234"), (1, "BANK", "850101/1234")]
    assert found(spark, "de89370400440532013000", "relaxed") == [(1, "BANK", "de89370400440532013000")]
    line = "  Dlouhá TŘÍDA " + "x" * 100
    assert found(spark, f"\n{line}", "balanced") == [(2, "ADDRESS", line.strip()[:80])]
    assert found(spark, line, "relaxed") == []
    # Cells know postcodes and names, lines do not.
    assert found(spark, "Jan Novák, 110 00", "strict") == []


@pytest.mark.parametrize("parts", [1, 5])
def test_keywords(spark, parts):
    texts = [(1, "x", "dva jedna Dva tři a to jako jsou"), (2, "x", "tři jedna"), (3, "y", ""), (4, "y", None)]
    df = spark.createDataFrame(texts, "d bigint, g string, text string").repartition(parts)
    rows = keywords_by_text(df, ["d"], "text").orderBy("d", "rank").collect()
    assert [(r["d"], r["rank"], r["term"], r["count"]) for r in rows] == [
        (1, 1, "dva", 2), (1, 2, "jedna", 1), (1, 3, "tři", 1), (2, 1, "tři", 1), (2, 2, "jedna", 1),
    ]
    for key in (["d"], ["g", "d"]):
        rows = keywords_by_group(df, key, "text", ["g"], limit=2).orderBy("rank").collect()
        assert [(r["g"], r["term"], r["count"]) for r in rows] == [("x", "dva", 2), ("x", "jedna", 2)]
    counts = {r["d"]: (r["char_count"], r["line_count"], r["word_count"]) for r in text_counts(df, ["d"], "text").collect()}
    assert counts == {1: (32, 1, 8), 2: (9, 1, 2), 3: (0, 0, 0), 4: (0, 0, 0)}
