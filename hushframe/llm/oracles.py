"""The results of the queries in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from hushframe.llm.line_dedup import LONG
from hushframe.llm.quality_rules import RULES, STOP_WORDS, Rule

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _fails(rule: Rule) -> str:
    value = f"{rule.part}::DOUBLE"
    if rule.whole:
        value = f"(CASE WHEN {rule.whole} > 0 THEN {rule.part}::DOUBLE / {rule.whole} ELSE 0.0 END)"
    tests = [f"{value} < {rule.low}"] * (rule.low is not None) + [f"{value} > {rule.high}"] * (rule.high is not None)
    return f"CASE WHEN n_words >= {rule.from_words} AND ({' OR '.join(tests)}) THEN '{rule.name}' END"


MIXING = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [1, 2, 3][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
level AS (
  SELECT 0 AS step, (SELECT sum(source_size)::BIGINT FROM s) AS open, (SELECT sum(weight)::BIGINT FROM s) AS parts
  UNION ALL
  SELECT step + 1,
         (SELECT sum(source_size) FROM s)::BIGINT - (SELECT coalesce(sum(3 * source_size), 0) FROM s WHERE 3 * source_size * parts <= weight * open)::BIGINT,
         (SELECT coalesce(sum(weight), 0) FROM s WHERE 3 * source_size * parts > weight * open)::BIGINT
  FROM level WHERE step < 40 AND parts > 0),
final AS (SELECT open, parts FROM level WHERE parts > 0 ORDER BY step DESC LIMIT 1),
r AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size * parts <= weight * open THEN (3 * source_size)::DOUBLE
              ELSE open::DOUBLE * weight / parts::DOUBLE END AS target
  FROM s, final),
x AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM x)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, {WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, w[i : i + 4] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN {STOP_WORDS}))::BIGINT AS n_stop_words,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM d LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         concat_ws(',', {", ".join(map(_fails, RULES))}) AS failed
  FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed = '' AS kept, n_lines, n_stop_words, n_bullet_lines, n_ellipsis_lines, failed
FROM judged
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL
  SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) AS g(i)),
e AS (
  SELECT *, CASE WHEN contains(x, CASE r WHEN 'user' THEN ' [/INST]' WHEN 'system' THEN ' [/SYS]' ELSE '</s>' END)
                   OR regexp_matches(x, '[<\[]\\+/?(?:s>|INST\]|SYS\]|ROLE\])')
                 THEN regexp_replace(x, '([<\[])(\\*/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1\\\2', 'g') ELSE x END AS y,
         CASE r WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 8 ELSE 20 + length(r) END AS marks
  FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
       coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(length(y) + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

JACCARD = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform({WORDS}, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i : i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, b FROM reach JOIN edges ON a = other)
SELECT d.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

LINES = rf"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
flat AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM parts),
own AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {LONG} AS long
  FROM flat WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (
  SELECT a.doc_id, a.pos AS start, 2 AS size, [a.line, b.line] AS run, [a.pos, b.pos] AS places
  FROM own a JOIN own b ON a.doc_id = b.doc_id AND b.k = a.k + 1
  UNION ALL SELECT doc_id, pos, 1, [line], [pos] FROM own WHERE long),
placed AS (SELECT *, min((doc_id, start)) OVER (PARTITION BY size, run) AS first FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(places) AS pos FROM placed WHERE (doc_id, start) > first),
kept AS (
  SELECT doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos), '')) AS kept_sha256
  FROM flat ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT p.doc_id, (SELECT count(*) FROM own WHERE own.doc_id = p.doc_id) AS n_lines,
       (SELECT count(*) FROM gone WHERE gone.doc_id = p.doc_id) AS n_removed,
       coalesce((SELECT string_agg(pos::VARCHAR, ',' ORDER BY pos) FROM gone WHERE gone.doc_id = p.doc_id), '') AS removed_lines,
       coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM parts p LEFT JOIN kept USING (doc_id)
"""

SUFFIXES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, s, md5_number(h[2 * s + 1 : 2 * s + 200]) AS k
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
jumps AS (SELECT *, s > lag(s + 100) OVER (PARTITION BY doc_id ORDER BY s) AS apart FROM later),
grouped AS (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM jumps),
spans AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM grouped GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(h[2 * gaps.a + 1 : coalesce(2 * gaps.b, length(h))], '' ORDER BY gaps.a) AS k
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

WINDOWS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op2_mixing": MIXING,
    "op3_quality_rules": QUALITY,
    "op4_chat_formatting": CHAT,
    "op6_jaccard_join": JACCARD,
    "op9_line_dedup": LINES,
    "op10_suffix_dedup": SUFFIXES,
    "op13_window_dedup": WINDOWS,
}
