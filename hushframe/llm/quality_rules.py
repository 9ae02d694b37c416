"""Quality rules: a threshold table, compiled into one projection of counts and ratios.

No user function is evaluated. Every count of a text is made inside its row, so there is no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.functions.text import let
from hushframe.llm.common import replacing, text_or_empty, words_of

WINDOW = 5
# What counts as a symbol, and common words of the four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this",
    "to", "was", "with", "au", "aux", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pas",
    "pour", "que", "qui", "un", "une", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "ist", "mit", "nicht",
    "sich", "und", "von", "zu", "con", "del", "el", "ella", "los", "no", "por", "se", "su", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """A document passes if `low <= ratio <= high`; documents with fewer words than `from_words` pass anyway."""

    name: str
    part: str
    whole: str | None = None
    low: float | None = None
    high: float | None = None
    from_words: int = 0

    def passes(self) -> Column:
        value = F.col(self.part).cast("double")
        if self.whole:
            value = F.when(F.col(self.whole) > 0, value / F.col(self.whole)).otherwise(0.0)
        test = F.lit(True)
        if self.low is not None:
            test = test & (value >= self.low)
        if self.high is not None:
            test = test & (value <= self.high)
        return test | (F.col("n_words") < self.from_words) if self.from_words else test


#: The table. Shares are of words or of lines with a word; the first two rules are the base.
RULES = (
    Rule("words", "n_words", low=10),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.20),
    Rule("word_length", "word_chars", "n_words", low=1.5, high=25.0),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", "n_words", low=0.01, from_words=50),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5, from_words=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9, from_words=50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.5, from_words=50),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_bullet_lines", "n_ellipsis_lines")


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more; `hashes` holds one value for each window."""

    def covered(pairs: Column) -> Column:
        def twice(pair: Column, at: Column) -> Column:
            same = lambda other: F.coalesce(F.get(pairs, other)["h"] == pair["h"], F.lit(False))
            return same(at - 1) | same(at + 1)

        starts = F.sort_array(F.transform(F.filter(pairs, twice), lambda pair: pair["i"]))
        # A window counts its words up to the start of the next repeated window.
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - at, F.lit(WINDOW)))),
            F.lit(0).cast("long"),
            lambda total, part: total + part,
        ))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, covered))


def quality_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of `COUNTS`, as longs.

    Null and empty texts have only zeros. Input columns that have the name of a count are replaced. The 64-bit
    hash of a window stands for its five words.
    """
    body = text_or_empty(text)
    words, lines = F.col("words"), F.col("lines")
    rows = docs.select(F.struct("*").alias("row"), body.alias("body"))
    rows = rows.select("row", "body", words_of(F.col("body")).alias("words"), F.split("body", "\n").alias("lines"))
    rows = rows.select("row", "body", "words", "lines", F.transform(words, lambda word: F.xxhash64(word)).alias("word_hashes"))
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("word_hashes"), i + k) for k in range(WINDOW)]),
    )
    rows = rows.select(
        "row", "body", "words",
        F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(F.size(words) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count("body", F.lit(f"[{re.escape(SYMBOLS)}]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(F.col("hashes")),
        "n_stop_words": F.size(F.filter(words, lambda word: F.lower(word).isin(*STOP_WORDS))),
        "n_bullet_lines": F.size(F.filter(lines, lambda line: line.rlike(r"^[\x20\x09-\x0D]*[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
    }
    # The generator keeps the counts from being evaluated again in filters above.
    made = F.inline(F.array(F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])))
    kept = [f"`{c.replace('`', '``')}`" for c in docs.columns if c.lower() not in counts]
    return rows.select("row", made).select(*[F.col(f"row.{c}") for c in kept], *counts)


def apply_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add counts, `base_failed`, `failed` (names of the broken rules) and `kept`.

    `base_failed` is true for fewer than ten words, or if more than a fifth of the words are in repeated windows;
    both are whole-number tests. A null or empty text fails. Tied or repeated rows are judged alike.
    """
    counted = quality_counts(docs, text)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~rule.passes(), rule.name) for rule in rules]))
    judged = replacing(counted, {"base_failed": base, "failed": failed})
    return replacing(judged, {"kept": ~F.col("base_failed") & (F.size("failed") == 0)})
