"""The same results in DuckDB SQL, written on their own: fixed values are repeated, not imported."""

from __future__ import annotations

from checks.people import AS_OF, NOTES, PEOPLE

SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
WORD = r"[\p{L}\p{N}_]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{2,3}\)?[\s-]?)?\d{3}[\s-]?\d{3}[\s-]?\d{3}\b"
RC = r"\b\d{2}[0-1]\d[0-3]\d/?\d{3,4}\b"
ACCOUNT = r"\b(?:\d{0,6}-)?\d{2,10}/\d{4}\b"
IBAN = r"\b[A-Za-z]{2}\d{2}[A-Za-z0-9]{11,30}\b"
POSTCODE = r"\b\d{3}\s?\d{2}\b"
DATES = ((r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "%d.%m.%Y"), (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"))
HINTS = ("ul.", "třída", "trida", "náměstí", "namesti", "č.p.", "c.p.", "č.o.", "c.o.")
STOP = "'aby','ale','ani','jako','jsou','nebo'"

PEOPLE_COLUMNS = (
    ("person_id", "int64"), ("email", "object"), ("telefon", "object"), ("rodne_cislo", "object"), ("iban", "object"),
    ("ucet", "object"), ("date_of_birth", "object"), ("created_at", "object"), ("event_date", "object"),
    ("name", "object"), ("city", "object"), ("note", "object"), ("phone_num", "float64"), ("balance", "float64"),
    ("active", "bool"), ("customer_id", "object"),
)
ORDER_COLUMNS = (
    ("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "object"), ("o_totalprice", "float64"),
    ("o_orderdate", "datetime64[us]"), ("o_orderpriority", "object"),
)
EVENT_COLUMNS = (
    ("event_id", "int64"), ("ts", "datetime64[us]"), ("user_id", "int64"), ("event_type", "object"),
    ("value", "float64"), ("props", "object"),
)
LINEITEM_COLUMNS = (
    ("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"), ("l_linenumber", "int32"),
    ("l_quantity", "float64"), ("l_extendedprice", "float64"), ("l_discount", "float64"), ("l_tax", "float64"),
)


def strip(text: str) -> str:
    return f"trim({text}, {SPACE})"


def canonical(name: str, dtype: str) -> str:
    if dtype == "bool":
        return f"CASE {name} WHEN true THEN 'True' WHEN false THEN 'False' END"
    return f"CAST({name} AS VARCHAR)"


def parsed_date(text: str) -> str:
    cases = " ".join(
        f"WHEN regexp_full_match({text}, '{p}') THEN CAST(try_strptime({text}, '{f}') AS DATE)" for p, f in DATES
    )
    return f"(CASE {cases} END)"


def in_range(day: str) -> str:
    return f"(coalesce(year({day}) >= 1900 AND {day} <= DATE '{AS_OF}', false))"


def valid_rc(text: str) -> str:
    n = f"replace({text}, '/', '')"
    mm = f"CAST(substr({n}, 3, 2) AS INT)"
    month = f"(CASE WHEN {mm} > 70 THEN {mm} - 70 WHEN {mm} > 50 THEN {mm} - 50 WHEN {mm} > 20 THEN {mm} - 20 ELSE {mm} END)"
    year = f"(CAST(substr({n}, 1, 2) AS INT) + CASE WHEN CAST(substr({n}, 1, 2) AS INT) <= {AS_OF[2:4]} THEN 2000 ELSE 1900 END)"
    day = f"try_strptime(CAST({year} AS VARCHAR) || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') || '-' || substr({n}, 5, 2), '%Y-%m-%d')"
    return (
        f"(CASE WHEN regexp_full_match({n}, '[0-9]{{9,10}}') THEN {day} IS NOT NULL"
        f" AND (length({n}) = 9 OR CAST({n} AS BIGINT) % 11 = 0) ELSE false END)"
    )


def digits(text: str) -> str:
    return f"length(regexp_replace({text}, '[^0-9]', '', 'g'))"


def hint(text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{h}')" for h in HINTS) + ")"


def mask_email(value: str) -> str:
    local = f"split_part({value}, '@', 1)"
    domain = f"substr({value}, instr({value}, '@') + 1)"
    label = f"split_part({domain}, '.', 1)"
    rest = f"substr({domain}, instr({domain}, '.') + 1)"

    def head(part):
        return f"(CASE WHEN length({part}) >= 2 THEN left({part}, 2) || '***' ELSE '***' END)"

    return (
        f"(CASE WHEN instr({value}, '@') = 0 THEN '***' WHEN instr({domain}, '.') > 0 THEN"
        f" {head(local)} || '@' || {head(label)} || '.' || {rest} ELSE {head(local)} || '@***' END)"
    )


def mask_phone(value: str) -> str:
    return (
        f"(CASE WHEN {digits(value)} = 0 THEN '***' ELSE"
        f" CASE WHEN starts_with({strip(value)}, '+') THEN '+420 ' ELSE '' END || '*** *** ***' END)"
    )


def mask_generic(value: str) -> str:
    text = strip(value)
    return f"(CASE WHEN length({text}) <= 2 THEN repeat('*', length({text})) ELSE left({text}, 1) || '***' || right({text}, 1) END)"


def mask(value: str, kind: str) -> str:
    return f"(CASE {kind} WHEN 'EMAIL' THEN {mask_email(value)} WHEN 'PHONE' THEN {mask_phone(value)} ELSE {mask_generic(value)} END)"


def cell_findings(source: str, columns, key: str, mode: str) -> str:
    """CTEs `cells` and `f` (one row per finding, with the unstripped text) over the table `source`."""
    flags = {
        "name": ("name",), "address": ("city",), "rc": ("rodne_cislo",), "birth": ("date_of_birth",), "ts": ("created_at",),
    }
    cells = " UNION ALL ".join(
        f"SELECT {key}, {i} AS column_ord, '{c}' AS col, {canonical(c, t)} AS raw FROM {source}" for i, (c, t) in enumerate(columns)
    )

    def col_is(flag):
        return f"(col IN ({', '.join(repr(n) for n in flags[flag])}))"

    by_column = {"strict": 0.72, "balanced": 0.62, "relaxed": 0.55}[mode]
    rc = f"(regexp_matches(cell, '{RC}')" + (")" if mode == "relaxed" else f" AND {valid_rc('cell')})")
    day = parsed_date("cell")
    bank = " OR ".join(f"regexp_matches(cell, '{p}')" for p in (ACCOUNT, IBAN))
    rules = [
        ("EMAIL", "regex_email", 0.99, 0, f"regexp_matches(cell, '{EMAIL}')"),
        ("PHONE", "regex_phone", 0.9, 1, f"regexp_matches(cell, '{PHONE}') AND {digits('cell')} BETWEEN 9 AND 15"),
        ("DOB", "regex_date", 0.88, 2, f"{in_range(day)} AND NOT {col_is('ts')} AND ({col_is('birth')} OR year({day}) < {int(AS_OF[:4]) - 10})"),
        ("RC", "regex_rc", 0.9, 3, rc),
        ("BANK", "regex_bank", 0.9, 4, f"({bank})"),
        ("RC", "column_rc_heuristic", 0.7, 5, f"{col_is('rc')} AND NOT {rc}"),
        ("NAME", "column_name_heuristic", by_column, 6, col_is("name")),
        ("ADDRESS", "column_address_heuristic", by_column, 7, col_is("address")),
    ]
    postcode = f"regexp_matches(cell, '{POSTCODE}')"
    if mode != "relaxed":
        rules.append(("ADDRESS", "postcode_heuristic", 0.6, 8, f"{postcode} AND NOT {col_is('address')}"))
    if mode == "strict":
        rules.append(("ADDRESS", "address_hint_heuristic", 0.65, 9, f"{hint('cell')} AND NOT {postcode} AND NOT {col_is('address')}"))
    found = " UNION ALL ".join(
        f"SELECT *, '{t}' AS pii_type, '{r}' AS rule, CAST({c} AS DOUBLE) AS confidence, {o} AS rule_order FROM cells WHERE {w}"
        for t, r, c, o, w in rules
    )
    return f"""cells AS (SELECT * FROM (SELECT *, {strip('raw')} AS cell FROM ({cells})) WHERE cell <> ''), f AS ({found})"""


def findings_select(key: str, dataset: str, source: str = "f") -> str:
    return (
        f"SELECT '{dataset}' AS dataset, {key}, column_ord, col AS \"column\", pii_type, rule, confidence,"
        f" {mask('cell', 'pii_type')} AS masked_preview, cell AS raw_value, rule_order FROM {source}"
    )


def people_findings(mode: str) -> str:
    return f"WITH p AS ({PEOPLE}), {cell_findings('p', PEOPLE_COLUMNS, 'person_id', mode)}"


def lines(source: str, key: str, text: str) -> str:
    return f"""lines AS (
      SELECT {key}, CAST(n AS BIGINT) AS line_no, parts[n] AS line FROM (
        SELECT {key}, parts, unnest(range(1, len(parts) + 1)) AS n FROM (
          SELECT {key}, regexp_split_to_array({text}, '{LINE_END}') AS parts FROM {source}))
      WHERE NOT (n = len(parts) AND parts[n] = ''))"""


def text_findings(source: str, key: str, text: str, mode: str) -> str:
    """CTEs `lines` and `t` (one row per finding with `match_no`)."""
    patterns = [
        ("EMAIL", "regex_text", 0.99, 0, EMAIL, "true"),
        ("PHONE", "regex_text", 0.9, 1, PHONE, f"{digits('raw')} BETWEEN 9 AND 15"),
        ("RC", "regex_text", 0.9, 2, RC, "true" if mode == "relaxed" else valid_rc("raw")),
        ("BANK", "regex_text", 0.9, 3, ACCOUNT, "true"),
        ("BANK", "regex_text", 0.9, 4, IBAN, "true"),
    ]
    day = parsed_date("raw")
    for i, (p, _) in enumerate(DATES):
        patterns.append(("DOB", "regex_date_text", 0.85, 5 + i, rf"\b{p}\b", f"{in_range(day)} AND year({day}) < {int(AS_OF[:4]) - 10}"))
    parts = [
        f"""SELECT {key}, line_no, '{t}' AS pii_type, '{r}' AS rule, CAST({c} AS DOUBLE) AS confidence, {o} AS rule_order, idx, raw
        FROM (SELECT {key}, line_no, unnest(m) AS raw, unnest(range(len(m))) AS idx FROM (
          SELECT *, regexp_extract_all(line, '{p}') AS m FROM lines)) WHERE {w}"""
        for t, r, c, o, p, w in patterns
    ]
    if mode != "relaxed":
        parts.append(
            f"SELECT {key}, line_no, 'ADDRESS', 'address_hint_text', CAST(0.6 AS DOUBLE), 8, 0, left({strip('line')}, 80) FROM lines WHERE {hint('line')}"
        )
    return f"""{lines(source, key, text)}, t AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY {key}, line_no ORDER BY rule_order, idx) - 1 AS INT) AS match_no
      FROM ({' UNION ALL '.join(parts)}))"""


def text_select(key: str, dataset: str) -> str:
    return (
        f"SELECT '{dataset}' AS dataset, {key}, line_no, match_no, 'text' AS \"column\", pii_type, rule, confidence,"
        f" {mask('raw', 'pii_type')} AS masked_preview, raw AS raw_value, rule_order FROM t"
    )


def text_detection(source: str, key: str, text: str, mode: str, dataset: str) -> str:
    return f"WITH {text_findings(source, key, text, mode)} {text_select(key, dataset)}"


def notes_findings(mode: str) -> str:
    return f"WITH n AS ({NOTES}), {text_findings('n', 'doc_id', 'text', mode)}"


SAFE = """safe AS (SELECT c_custkey AS person_id, col, pii_type, rule FROM customer,
  (VALUES ('note', 'ADDRESS', 'postcode_heuristic'), ('name', 'NAME', 'column_name_heuristic')) v(col, pii_type, rule)
  WHERE c_acctbal < 0)"""
EFFECTIVE = "e AS (SELECT f.* FROM f ANTI JOIN safe s ON f.person_id = s.person_id AND f.col = s.col AND f.pii_type = s.pii_type AND f.rule = s.rule)"


def tokens(key: str, source: str, batch: str = "0") -> str:
    """CTEs `steps` (a finding with the types before it), `entries` (numbered tokens) and `last` (final tokens).

    Rows of an earlier `batch` come before those of later ones.
    """
    return f"""steps AS (
      SELECT *, coalesce(string_agg(pii_type, '>') OVER w, '') AS chain,
             row_number() OVER (PARTITION BY {key}, column_ord ORDER BY rule_order DESC) AS from_end
      FROM {source} WINDOW w AS (PARTITION BY {key}, column_ord ORDER BY rule_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    entries AS (
      SELECT *, row_number() OVER (PARTITION BY pii_type ORDER BY first_seen) AS token_no FROM (
        SELECT pii_type, chain, raw, count(*) AS occurrences, min(({batch}, column_ord, {key})) AS first_seen, min({batch}) AS batch
        FROM steps GROUP BY ALL)),
    named AS (SELECT *, pii_type || '_' || CAST(token_no AS VARCHAR) AS token FROM entries),
    last AS (SELECT s.{key}, s.col, n.token FROM steps s JOIN named n USING (pii_type, chain, raw) WHERE s.from_end = 1)"""


def anonymized(source: str, columns, key: str, extra: str = "") -> str:
    picks = ", ".join(f"max(CASE WHEN col = '{c}' THEN token END) AS {c}" for c, _ in columns)
    shown = ", ".join(f"coalesce(w.{c}, {canonical(f's.{c}', t)}) AS {c}" for c, t in columns)
    return f"SELECT {shown}{extra} FROM {source} s LEFT JOIN (SELECT {key} AS k, {picks} FROM last GROUP BY {key}) w ON s.{key} = w.k"


TEXT_TOKENS = """d AS (
      SELECT *, row_number() OVER (PARTITION BY {key}, pii_type ORDER BY length(raw) DESC, first_at) AS token_no FROM (
        SELECT {key}, pii_type, raw, min(line_no * 100000 + match_no) AS first_at FROM t GROUP BY ALL)),
    dict AS (SELECT *, pii_type || '_' || CAST(token_no AS VARCHAR) AS token FROM d),
    pairs AS (SELECT {key}, list({{'raw': raw, 'token': token}} ORDER BY length(raw) DESC, first_at) AS p FROM dict GROUP BY {key})"""


def text_tokens(key: str) -> str:
    return TEXT_TOKENS.format(key=key)


def replaced_text(source: str, key: str, text: str) -> str:
    fold = (
        f"list_reduce(list_prepend({{'raw': {text}, 'token': ''}}, p),"
        " lambda a, x: {'raw': replace(a.raw, x.raw, x.token), 'token': ''}).raw"
    )
    return f"SELECT s.{key}, CASE WHEN p IS NULL THEN {text} ELSE {fold} END AS {text} FROM {source} s LEFT JOIN pairs USING ({key})"


def line_count(text: str) -> str:
    parts = f"regexp_split_to_array({text}, '{LINE_END}')"
    return f"CASE WHEN {parts}[-1] = '' THEN len({parts}) - 1 ELSE len({parts}) END"


def word_count(text: str) -> str:
    return f"len(regexp_extract_all(lower({text}), '{WORD}'))"


def numeric(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS column_ord, '{c}' AS \"column\", round(CAST(min({c}) AS DOUBLE), 4) AS min,"
        f" round(CAST(max({c}) AS DOUBLE), 4) AS max, round(avg({c}), 4) AS mean, round(CAST(median({c}) AS DOUBLE), 4) AS median FROM {source}"
        for i, (c, t) in enumerate(columns) if t not in ("object", "bool") and not t.startswith("datetime")
    )


def top_values(source: str, columns) -> str:
    cells = " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS column_ord, '{c}' AS \"column\", coalesce({canonical(c, t)}, 'nan') AS value FROM {source}"
        for i, (c, t) in enumerate(columns) if t == "object" or t.startswith("datetime")
    )
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY column_ord ORDER BY "count" DESC, value) AS INT) AS rank
      FROM (SELECT column_ord, "column", value, count(*) AS "count" FROM ({cells}) GROUP BY ALL)) WHERE rank <= 5"""


def keywords(group: str, first: str) -> str:
    return f"""w AS (SELECT {group}, doc_id AS dk, unnest(m) AS term, unnest(range(len(m))) AS pos FROM (
        SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}') AS m FROM documents)),
      k AS (SELECT {group}, term, count(*) AS "count", min({first}) AS seen FROM w WHERE term NOT IN ({STOP}) GROUP BY ALL),
      ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {group} ORDER BY "count" DESC, seen) AS INT) AS rank FROM k)"""


def schema_rows(columns) -> str:
    return ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(columns))


REQUESTS = f"""
{notes_findings('relaxed')},
known AS (SELECT c_custkey AS dataset, c_custkey % 5 <> 0 AND c_custkey IN (SELECT doc_id FROM t) AS found
          FROM customer WHERE c_custkey % 6 <> 0),
r AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END AS prompt,
             length(text) > 60 AND (conv_id + turn) % 11 <> 1 AS submitted, conv_id % 3 = 0 AND (conv_id + turn) % 11 <> 2 AS wants,
             turn = 0 AND (conv_id + turn) % 11 <> 3 AS available, found AS has_pii, found IS NOT NULL AS scanned,
             coalesce(found, true) AS maybe
      FROM conversations LEFT JOIN known ON conv_id % 13 <> 0 AND dataset = conv_id % 150 WHERE role = 'user')
"""
REASON = (
    "CASE WHEN NOT submitted THEN 'submit_not_clicked' WHEN NOT scanned THEN 'not_scanned' {extra} WHEN " + strip("prompt")
    + " = '' THEN 'empty_prompt' WHEN has_pii AND NOT {used} THEN 'pii_requires_anonymization' ELSE 'ok' END"
)


def size_text(value: str) -> str:
    def shown(power, unit):
        return f"format('{{:.1f}} {unit}', CAST({value} AS DOUBLE) / {1024**power})"

    return (
        f"CASE WHEN {value} < 1024 THEN {shown(0, 'B')} WHEN {value} < {1024**2} THEN {shown(1, 'KB')}"
        f" WHEN {value} < {1024**3} THEN {shown(2, 'MB')} ELSE {shown(3, 'GB')} END"
    )


def _text_keywords() -> str:
    return f"{keywords('doc_id', 'pos')}, kw AS (SELECT doc_id, list({{'term': term, 'count': \"count\"}} ORDER BY rank) AS keywords FROM ranked WHERE rank <= 15 GROUP BY doc_id)"


def _payload_guard() -> str:
    def payload(sample: str) -> str:
        return f"""to_json({{'task': 'Summarise the data.', 'dataset': {{'schema': []::VARCHAR[], 'stats': {{'char_count': length(text),
          'line_count': {line_count('text')}, 'word_count': {word_count('text')}, 'keywords': coalesce(keywords, [])}}{sample}}},
          'analysis_scope': ['Respond in Czech and only use the provided context.']}})"""

    return f"""WITH {_text_keywords()}, {lines('documents', 'doc_id', 'text')},
      s AS (SELECT doc_id, list(line ORDER BY line_no) AS sample FROM lines WHERE line_no <= 100 GROUP BY doc_id),
      -- What an indent of two adds: brackets, lines and keys of the fixed parts, of keywords and of sample lines.
      x AS (SELECT *, coalesce(len(keywords), 0) AS k, coalesce(len(sample), 0) AS l FROM documents LEFT JOIN kw USING (doc_id) LEFT JOIN s USING (doc_id)),
      b AS (SELECT doc_id, octet_length(encode(CAST({payload(", 'sample': coalesce(sample, [])")} AS VARCHAR))) + 61 + 18
                     + CASE WHEN k > 0 THEN 42 * k + 7 ELSE 0 END + CASE WHEN l > 0 THEN 7 * l + 5 ELSE 0 END AS full_bytes,
                   octet_length(encode(CAST({payload('')} AS VARCHAR))) + 61 + 12 + CASE WHEN k > 0 THEN 42 * k + 7 ELSE 0 END AS short_bytes
            FROM x)
      SELECT doc_id, full_bytes > 2048 AS truncated,
             CAST(CASE WHEN full_bytes > 2048 THEN short_bytes ELSE full_bytes END AS BIGINT) AS payload_bytes,
             CASE WHEN full_bytes > 2048 THEN short_bytes ELSE full_bytes END > 2048 AS still_over FROM b"""


def _context_stats() -> str:
    missing = " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) - count({c}) AS missing FROM p" for c, _ in PEOPLE_COLUMNS)
    return f"""WITH p AS ({PEOPLE}), m AS ({missing}), s AS ({numeric('p', PEOPLE_COLUMNS)})
      SELECT 'people' AS dataset, 'Balanced' AS privacy_mode, 'schema+stats' AS scope, (SELECT count(*) FROM p) AS row_count,
             CAST(16 AS BIGINT) AS column_count, (SELECT count(*) FROM p) - (SELECT count(*) FROM (SELECT DISTINCT * FROM p)) AS duplicate_rows,
             v.col AS "column", v.dtype, m.missing, s.min, s.max, s.mean, s.median
      FROM (VALUES {schema_rows(PEOPLE_COLUMNS)}) v(ord, col, dtype) JOIN m USING (col) LEFT JOIN s ON s."column" = v.col"""


def _normalised() -> str:
    return f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN {strip('text || chr(10) || role')}
      WHEN 1 THEN {strip('role || chr(10) || text')} ELSE text END AS content FROM conversations"""


def _sample(limit: int, columns: str) -> str:
    return f"SELECT {columns} FROM events ORDER BY event_id LIMIT {limit}"


def _flag_rows() -> str:
    flags = {"name": (1, 0, 0, 0, 0), "city": (0, 1, 0, 0, 0), "rodne_cislo": (0, 0, 1, 0, 0), "date_of_birth": (0, 0, 0, 1, 0), "created_at": (0, 0, 0, 0, 1)}
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, count(*) FILTER (WHERE {strip(canonical(c, t))} <> '') AS cells FROM p" for c, t in PEOPLE_COLUMNS
    )
    rows = ", ".join(f"('{c}', {', '.join('true' if f else 'false' for f in flags.get(c, (0,) * 5))})" for c, _ in PEOPLE_COLUMNS)
    return f"""WITH p AS ({PEOPLE}), n AS ({counts}) SELECT col AS "column", cells, is_name, is_address, is_rc, is_birth, is_timestamp
      FROM n JOIN (VALUES {rows}) v(col, is_name, is_address, is_rc, is_birth, is_timestamp) USING (col)"""


PEOPLE_STRICT = people_findings("strict")
ORDERS_BALANCED = f"WITH {cell_findings('orders', ORDER_COLUMNS, 'o_orderkey', 'balanced')}"

ORACLES: dict[str, str] = {
    "catalog_filters": """SELECT 'documents' AS source, doc_id AS id FROM documents WHERE n_chars BETWEEN 1024 AND 4096
      UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'""",
    "file_kinds": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.md' ELSE '' END AS extension,
      CASE doc_id % 3 WHEN 0 THEN 'csv' ELSE 'text' END AS kind FROM documents""",
    "csv_round_trip": f"SELECT {', '.join(f'nullif({canonical(c, t)}, {chr(39)*2}) AS {c}' for c, t in PEOPLE_COLUMNS)} FROM ({PEOPLE}) p",
    "delimiter_fallback": f"""SELECT CASE person_id % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END AS delimiter,
      person_id, telefon, city, date_of_birth FROM ({PEOPLE}) p""",
    "release_payload_cells": f"""{PEOPLE_STRICT}, {tokens('person_id', 'f')},
      a AS ({anonymized('p', PEOPLE_COLUMNS, 'person_id', ', s.person_id AS place')}),
      s AS (SELECT *, row_number() OVER (ORDER BY place) - 1 AS row_no FROM a ORDER BY place LIMIT 100) """ + " UNION ALL ".join(
        f"""SELECT row_no, '{c}' AS "column", {f'lower({c})' if c == 'active' else c} AS value, (SELECT count(*) FROM p) AS row_count,
      (SELECT count(*) - count({c}) FROM p) AS missing FROM s""" for c, _ in PEOPLE_COLUMNS if c not in ("person_id", "customer_id")
    ),
    "release_payload_lines": f"""{notes_findings('balanced')}, {text_tokens('doc_id')}, a AS ({replaced_text('n', 'doc_id', 'text')})
      SELECT * FROM (WITH {lines('a', 'doc_id', 'text')} SELECT doc_id, CAST(line_no - 1 AS INT) AS line_no, line FROM lines WHERE line_no <= 200)""",
    "text_export": f"{notes_findings('strict')}, {text_tokens('doc_id')} {replaced_text('n', 'doc_id', 'text')}",
    "folder_exploration": f"""WITH p AS ({PEOPLE}), q AS (SELECT {', '.join(f'{canonical(c, t)} AS {c}' for c, t in PEOPLE_COLUMNS)} FROM p),
      {cell_findings('q', [(c, 'string') for c, _ in PEOPLE_COLUMNS], 'person_id', 'strict')},
      x AS ({notes_findings('strict')} SELECT * FROM t),
      n AS ({NOTES}),
      e AS (
        SELECT 'people' AS dataset, 'findings' AS event, pii_type AS subject, col AS detail, count(*) AS amount FROM f GROUP BY pii_type, col
        UNION ALL SELECT 'notes', 'findings', pii_type, 'text', count(*) FROM x GROUP BY pii_type
        UNION ALL SELECT 'damaged', 'findings', 'EMAIL', '(record)', count(*) FROM customer WHERE c_custkey % 10 = 1)
      SELECT * FROM e
      UNION ALL SELECT dataset, 'pii_detection', subject, 'has_pii=true', sum(amount)::BIGINT FROM e GROUP BY dataset, subject
      UNION ALL SELECT 'regions', 'pii_detection', NULL, 'has_pii=false', 0
      UNION ALL SELECT 'bare', 'pii_detection', NULL, 'has_pii=false', 0
      UNION ALL SELECT 'damaged', 'records_quarantined', ['surplus_fields', 'missing_fields', 'undecodable'][(c_custkey % 10)::INT], NULL, count(*)
        FROM customer WHERE c_custkey % 10 IN (1, 2, 3) GROUP BY c_custkey % 10
      UNION ALL SELECT 'people', 'profile', 'size', '{len(PEOPLE_COLUMNS)}', count(*) FROM p
      UNION ALL SELECT 'regions', 'profile', 'size', '2', count(*) FROM region
      UNION ALL SELECT 'bare', 'profile', 'size', '2', 0
      UNION ALL SELECT 'damaged', 'profile', 'size', '2', count(*) FROM customer
      UNION ALL SELECT 'notes', 'profile', 'size', NULL, sum({word_count('text')})::BIGINT FROM n""",
    "csv_quarantine": """SELECT c_custkey AS person_id, ['surplus_fields', 'missing_fields', 'undecodable'][(c_custkey % 10)::INT] AS reason,
      (c_custkey % 10 = 1)::BIGINT AS found FROM customer WHERE c_custkey % 10 IN (1, 2, 3)""",
    "csv_split_records": """SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey,
      l_returnflag || '," ' || l_linestatus || CASE WHEN l_linenumber % 3 = 0 THEN chr(10) || chr(10) || ',x' || chr(10) ELSE '' END AS remark FROM lineitem""",
    "folder_refresh": f"""WITH p AS ({PEOPLE}), q AS (SELECT {', '.join(f'{canonical(c, t)} AS {c}' for c, t in PEOPLE_COLUMNS)} FROM p),
      {cell_findings('q', [(c, 'string') for c, _ in PEOPLE_COLUMNS], 'person_id', 'strict')}
      SELECT pii_type AS part, count(*) AS amount FROM f GROUP BY pii_type
      UNION ALL SELECT 'all rows', count(*) FROM p
      UNION ALL SELECT 'rows read again', count(*) FROM p WHERE person_id % 2 = 1""",
    "text_lines": r"""SELECT md5(line) AS digest, count(*) AS amount
      FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')) AS line FROM documents) t WHERE line <> '' GROUP BY line""",
    "csv_mixed_headers": f"""WITH p AS (SELECT *, note || ';a,b' || chr(10) || 'c,' || city AS remark FROM ({PEOPLE}) q)
      SELECT ',' AS delimiter, 'person_id,city,remark' AS header, person_id, city, remark, NULL AS telefon, NULL AS date_of_birth FROM p WHERE person_id % 3 = 0
      UNION ALL SELECT ',', 'remark,person_id,telefon', person_id, NULL, remark, telefon, NULL FROM p WHERE person_id % 3 = 1
      UNION ALL SELECT ';', 'person_id;date_of_birth', person_id, NULL, NULL, NULL, 'x,' || date_of_birth FROM p WHERE person_id % 3 = 2""",
    "anonymized_keyless": f"""{PEOPLE_STRICT}, ends AS (SELECT person_id, col, arg_max(pii_type, rule_order) AS last FROM f GROUP BY ALL),
      c AS ({" UNION ALL ".join(f"SELECT person_id, '{c}' AS col, {c} AS v FROM p" for c in ("email", "telefon", "rodne_cislo", "city", "note"))})
      SELECT col AS "column", coalesce(last || '_', v) AS form, count(*) AS cells FROM c LEFT JOIN ends USING (person_id, col) GROUP BY ALL""",
    "text_source": r"SELECT page_id, md5(regexp_replace(html || chr(13) || chr(10) || 'end' || chr(13), '\r\n?', chr(10), 'g')) AS digest FROM pages",
    "preview_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20",
    "preview_text": "SELECT doc_id, left(text, 5000) AS preview FROM documents",
    "profile_counts": "SELECT count(*) AS row_count, CAST(11 AS BIGINT) AS column_count FROM lineitem",
    "profile_schema": f"""SELECT CAST(ord AS INT) AS column_ord, col AS "column", dtype, (SELECT count(*) FROM events) AS row_count
      FROM (VALUES {schema_rows(EVENT_COLUMNS)}) v(ord, col, dtype)""",
    "profile_missing": f"WITH p AS ({PEOPLE}) " + " UNION ALL ".join(
        f"SELECT CAST({i} AS INT) AS column_ord, '{c}' AS \"column\", count(*) - count({c}) AS missing FROM p" for i, (c, _) in enumerate(PEOPLE_COLUMNS)
    ),
    "profile_numeric": numeric("lineitem", LINEITEM_COLUMNS),
    "profile_numeric_nulls": f"WITH p AS ({PEOPLE}) {numeric('p', PEOPLE_COLUMNS)}",
    "profile_top_values": top_values("orders", ORDER_COLUMNS),
    "profile_top_values_nulls": f"WITH p AS ({PEOPLE}) {top_values('p', PEOPLE_COLUMNS)}",
    "profile_top_values_texts": """WITH c AS (SELECT 1 AS ord, 'text' AS col, text AS value FROM documents
        UNION ALL SELECT 2, 'lang', lang FROM documents UNION ALL SELECT 3, 'source', source FROM documents),
      k AS (SELECT ord, col, value, count(*) AS n FROM c GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY n DESC, value) AS rank FROM k)
      SELECT CAST(ord AS INT) AS column_ord, col AS "column", value, n AS "count", CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
    "profile_duplicates": """WITH l AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)
      SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM l)) AS duplicate_rows FROM l""",
    "profile_duplicates_wide": """WITH d AS (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE lang = 'en')
      SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows FROM d""",
    "text_profile": f"""SELECT doc_id, length(text) AS char_count, CAST({line_count('text')} AS BIGINT) AS line_count,
      CAST({word_count('text')} AS BIGINT) AS word_count FROM documents""",
    "keywords_by_doc": f"WITH {keywords('doc_id', 'pos')} SELECT doc_id, rank, term, \"count\" FROM ranked WHERE rank <= 15",
    "keywords_by_lang": f"WITH {keywords('lang', '(dk, pos)')} SELECT lang, rank, term, \"count\" FROM ranked WHERE rank <= 15",
    "column_flags": _flag_rows(),
    "pii_cells_orders": f"WITH {cell_findings('orders', ORDER_COLUMNS, 'o_orderkey', 'strict')} {findings_select('o_orderkey', 'orders')}",
    "pii_cells_events": f"WITH {cell_findings('events', EVENT_COLUMNS, 'event_id', 'balanced')} {findings_select('event_id', 'events')}",
    "pii_text_documents": text_detection("documents", "doc_id", "text", "strict", "documents"),
    "pii_text_pages": text_detection("pages", "page_id", "html", "strict", "pages"),
    "pii_text_conversations": f"""WITH c AS (SELECT conv_id, turn, text || CASE WHEN (conv_id + turn) % 5 = 0
        THEN chr(10) || 'novak' || conv_id || '@example.com, +420 602 123 456' ELSE '' END AS text FROM conversations),
      {text_findings('c', 'conv_id, turn', 'text', 'balanced')} {text_select('conv_id, turn', 'conversations')}""",
    "pii_report_totals": f"{PEOPLE_STRICT} SELECT pii_type, count(*) AS total FROM f GROUP BY pii_type",
    "pii_report_columns": f"{PEOPLE_STRICT} SELECT pii_type, string_agg(DISTINCT col, ',' ORDER BY col) AS columns FROM f GROUP BY pii_type",
    "pii_report_rows": f"{PEOPLE_STRICT} SELECT DISTINCT pii_type, person_id FROM f",
    "pii_has_pii": f"{PEOPLE_STRICT} SELECT count(*) > 0 AS has_pii FROM f",
    "pii_effective_strict": f"{PEOPLE_STRICT}, {SAFE}, {EFFECTIVE} {findings_select('person_id', 'people', 'e')}",
    "pii_masked_samples": f"SELECT * EXCLUDE (raw_value) FROM ({PEOPLE_STRICT} {findings_select('person_id', 'people')}) ORDER BY column_ord, person_id, rule_order LIMIT 200",
    "audit_detection_summary": f"""{PEOPLE_STRICT} SELECT 'pii_detection' AS event, 'people' AS dataset, 'Strict' AS mode, pii_type AS subject,
      'has_pii=true' AS detail, count(*) AS amount FROM f GROUP BY pii_type
      UNION ALL SELECT 'pii_detection', 'regions', 'Strict', NULL, 'has_pii=false', 0""",
    "audit_log": f"""{PEOPLE_STRICT} SELECT 'pii_detection' AS event, 'people' AS dataset, 'Strict' AS mode, pii_type AS subject,
      'has_pii=true' AS detail, count(*) AS amount, run FROM f, (VALUES ('first'), ('second')) r(run) GROUP BY pii_type, run""",
    "audit_events": f"""{REQUESTS}
      SELECT 'profiling_completed' AS event, 'people' AS dataset, NULL AS mode, 'csv' AS subject, NULL AS detail, count(*) AS amount FROM customer
      UNION ALL SELECT 'anonymization_completed', 'people', 'Strict', pii_type, NULL, count(*) FROM ({PEOPLE_STRICT} SELECT pii_type FROM f) x GROUP BY pii_type
      UNION ALL SELECT 'safe_marked', CASE WHEN c_acctbal < 0 OR c_custkey % 2 = 0 THEN 'people' ELSE 'others' END,
        CASE WHEN c_acctbal < 0 OR c_custkey % 2 = 1 THEN 'Strict' ELSE 'Relaxed' END, pii_type, mark, 1
        FROM customer, (VALUES ('ADDRESS', 'note/postcode_heuristic'), ('NAME', 'name/column_name_heuristic')) m(pii_type, mark)
      UNION ALL SELECT 'release_decided', CASE WHEN conv_id % 13 <> 0 THEN CAST(conv_id % 150 AS VARCHAR) END, 'Strict',
        {REASON.format(extra='', used='wants')}, 'schema/original', turn FROM r""",
    "mask_emails": f"""WITH p AS ({PEOPLE}) SELECT person_id, {mask_email('email')} AS email, {mask_email('note')} AS note,
      {mask_email(f"regexp_extract(note, '{EMAIL}')")} AS note_match FROM p""",
    "mask_phones": f"WITH p AS ({PEOPLE}) SELECT person_id, {mask_phone('telefon')} AS telefon, {mask_phone('city')} AS city FROM p",
    "mask_texts": f"SELECT doc_id, {mask_generic('lang')} AS lang, {mask_generic('text')} AS text FROM documents",
    "mask_by_type": f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN {mask_email('v')} WHEN 1 THEN {mask_phone('v')} ELSE {mask_generic('v')} END AS masked
      FROM (SELECT *, CASE WHEN c_acctbal > 0 THEN c_name ELSE '' END AS v FROM customer)""",
    "token_dictionary_cells": f"{PEOPLE_STRICT}, {tokens('person_id', 'f')} SELECT pii_type, chain, raw, token_no, token, occurrences FROM named",
    "token_map_cells": f"""{PEOPLE_STRICT}, {tokens('person_id', 'f')}
      SELECT pii_type, coalesce(before, raw) AS value, token FROM (
        SELECT DISTINCT s.pii_type, s.raw, n.token, b.token AS before
        FROM steps s JOIN named n USING (pii_type, chain, raw)
        LEFT JOIN (SELECT s2.person_id, s2.column_ord, s2.rule_order, n2.token FROM steps s2 JOIN named n2 USING (pii_type, chain, raw)) b
          ON s.chain <> '' AND b.person_id = s.person_id AND b.column_ord = s.column_ord
          AND b.rule_order = (SELECT max(rule_order) FROM f WHERE f.person_id = s.person_id AND f.column_ord = s.column_ord AND f.rule_order < s.rule_order))""",
    "anonymized_people": f"{PEOPLE_STRICT}, {tokens('person_id', 'f')} {anonymized('p', PEOPLE_COLUMNS, 'person_id')}",
    "anonymized_people_effective": f"{PEOPLE_STRICT}, {SAFE}, {EFFECTIVE}, {tokens('person_id', 'e')} {anonymized('p', PEOPLE_COLUMNS, 'person_id')}",
    "streamed_people": f"{PEOPLE_STRICT}, {tokens('person_id', 'f', 'person_id % 2')} {anonymized('p', PEOPLE_COLUMNS, 'person_id')}",
    "streamed_tokens": f"""{ORDERS_BALANCED.replace('WITH ', 'WITH b AS (SELECT o_orderkey AS k, o_custkey % 2 AS batch FROM orders), ', 1)},
      g AS (SELECT f.*, b.batch AS in_batch FROM f JOIN b ON f.o_orderkey = b.k), {tokens('o_orderkey', 'g', 'in_batch')}
      SELECT pii_type, chain, raw, token_no, token, batch FROM named""",
    "anonymized_orders": f"{ORDERS_BALANCED}, {tokens('o_orderkey', 'f')} {anonymized('orders', ORDER_COLUMNS, 'o_orderkey')}",
    "replaced_counts": f"{PEOPLE_STRICT} SELECT pii_type, count(*) AS replaced FROM f GROUP BY pii_type",
    "token_dictionary_text": f"{notes_findings('strict')}, {text_tokens('doc_id')} SELECT doc_id, pii_type, raw, token_no, token FROM dict",
    "anonymized_notes": f"{notes_findings('strict')}, {text_tokens('doc_id')} {replaced_text('n', 'doc_id', 'text')}",
    "anonymized_notes_effective": f"""{notes_findings('strict').replace(', t AS (', ', t0 AS (', 1)}, t AS (
      SELECT * FROM t0 WHERE NOT (line_no = 2 AND pii_type = 'PHONE' AND doc_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))),
      {text_tokens('doc_id')} {replaced_text('n', 'doc_id', 'text')}""",
    "anonymized_documents": f"WITH {text_findings('documents', 'doc_id', 'text', 'strict')}, {text_tokens('doc_id')} {replaced_text('documents', 'doc_id', 'text')}",
    "context_schema": f"""SELECT 'people' AS dataset, 'schema' AS scope, col AS "column", dtype, (SELECT count(*) FROM customer) AS row_count
      FROM (VALUES {schema_rows(PEOPLE_COLUMNS)}) v(ord, col, dtype)""",
    "context_stats": _context_stats(),
    "context_text": f"""WITH {_text_keywords()} SELECT doc_id, 'text' AS file_kind, 'Balanced' AS privacy_mode, 'schema' AS scope, length(text) AS char_count,
      CAST({line_count('text')} AS BIGINT) AS line_count, CAST({word_count('text')} AS BIGINT) AS word_count,
      coalesce(array_to_string([x.term || ':' || CAST(x."count" AS VARCHAR) FOR x IN keywords], ','), '') AS keywords
      FROM documents LEFT JOIN kw USING (doc_id)""",
    "id_like_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, count({c}) >= 50 AND count(DISTINCT {c}) >= 0.95 * count({c}) AS dropped FROM events"
        for c in ("event_id", "user_id")
    ),
    "sample_strict": _sample(100, "* EXCLUDE (event_id)"),
    "sample_balanced": _sample(200, "*"),
    "sample_relaxed": _sample(300, "*"),
    "sample_lines": f"""WITH {lines('documents', 'doc_id', 'text')}, c AS (SELECT doc_id, least(count(*), 100) AS sample_row_count FROM lines GROUP BY doc_id)
      SELECT doc_id, sample_row_count, CAST(line_no - 1 AS INT) AS line_no, line FROM lines JOIN c USING (doc_id) WHERE line_no <= 100""",
    "release_payload_stats": f"""WITH p AS ({PEOPLE}), v AS (VALUES {schema_rows(PEOPLE_COLUMNS)})
      SELECT 'task' AS part, '' AS "column", 'Summarise the data.' AS text, NULL::DOUBLE AS number
      UNION ALL SELECT 'schema', col1, CASE WHEN col1 = 'phone_num' THEN 'object' ELSE col2 END, NULL FROM v
      UNION ALL SELECT 'row_count', '', NULL, count(*) FROM p
      UNION ALL SELECT 'column_count', '', NULL, {len(PEOPLE_COLUMNS)}
      UNION ALL SELECT 'duplicate_rows', '', NULL, 0
      """ + " ".join(f"UNION ALL SELECT 'missing', '{c}', NULL, count(*) - count({c}) FROM p" for c, _ in PEOPLE_COLUMNS)
    + " ".join(
        f" UNION ALL SELECT '{name}', '{c}', NULL, round({f}({c}::DOUBLE), 4) FROM p"
        for c in ("person_id", "balance") for name, f in (("min", "min"), ("max", "max"), ("mean", "avg"), ("median", "median"))
    ),
    "payload_default_limit": """SELECT sum(strlen(text)) > 204800 AS truncated, false AS still_over, sum(strlen(text)) <= 204800 AS has_sample, true AS fits
      FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 300)""",
    "payload_size_guard": _payload_guard(),
    "release_decisions": f"{REQUESTS} SELECT conv_id, turn, has_pii, {REASON.format(extra='', used='wants')} AS reason FROM r",
    "released_requests": f"{REQUESTS} SELECT conv_id, turn FROM r WHERE {REASON.format(extra='', used='wants')} = 'ok'",
    "release_source": f"""{REQUESTS} SELECT conv_id, turn, CASE WHEN maybe OR wants THEN 'anonymized' ELSE 'original' END AS source,
      (maybe OR wants) AND NOT available AS source_missing,
      {REASON.format(extra="WHEN (maybe OR wants) AND NOT available THEN 'anonymized_missing'", used='(maybe OR wants)')} AS reason FROM r""",
    "conversation_newest_first": """WITH g AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
        OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_group FROM conversations)
      SELECT conv_id, turn, role, text, turn_group, row_number() OVER (PARTITION BY conv_id ORDER BY turn_group DESC, turn) AS position FROM g""",
    "conversation_tied_turns": """WITH m AS (SELECT CASE WHEN conv_id % 3 = 0 THEN -1 ELSE conv_id END AS conv_id, (conv_id * 64 + turn) // 2 AS turn, role, text FROM conversations),
      g AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_group FROM m)
      SELECT conv_id, turn, role, md5(text) AS digest, turn_group,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn_group DESC, turn, role, text) AS position FROM g""",
    "conversation_without_users": """WITH m AS (SELECT CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE conv_id END AS conv_id, conv_id * 64 + turn AS turn,
        CASE conv_id % 3 WHEN 1 THEN 'system' ELSE role END AS role, text FROM conversations),
      g AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text
              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_group FROM m)
      SELECT coalesce(conv_id, -2) AS conv_id, turn, role, md5(text) AS digest, turn_group,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn_group DESC, turn, role, text) AS position FROM g""",
    "conversation_append": f"""SELECT conv_id, turn, role, text FROM conversations
      UNION ALL SELECT doc_id, coalesce(last, -1) + step, CASE step WHEN 1 THEN 'user' ELSE 'assistant' END,
        CASE step WHEN 1 THEN {strip("'  ' || lang || chr(10)")} ELSE source END
      FROM documents CROSS JOIN (VALUES (1), (2)) s(step) LEFT JOIN (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) l ON l.conv_id = doc_id""",
    "content_normalise": _normalised(),
    "format_sizes": f"SELECT doc_id, {size_text('b')} AS shown FROM (SELECT doc_id, n_chars * CAST(pow(1024, doc_id % 4) AS BIGINT) AS b FROM documents)",
}
for _mode in ("strict", "balanced", "relaxed"):
    ORACLES[f"pii_cells_{_mode}"] = f"{people_findings(_mode)} {findings_select('person_id', 'people')}"
for _mode in ("strict", "relaxed"):
    ORACLES[f"pii_text_notes_{_mode}"] = f"{notes_findings(_mode)} {text_select('doc_id', 'notes')}"
ORACLES["anonymized_people_joined"] = ORACLES["anonymized_people"]
ORACLES["anonymized_keyless_joined"] = ORACLES["anonymized_keyless"]
# Substitutions that took place: lengths before and after each step of the fold.
ORACLES["replaced_counts_text"] = f"""WITH RECURSIVE n AS ({NOTES}), {text_findings('n', 'doc_id', 'text', 'strict')}, {text_tokens('doc_id')},
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(raw) DESC, first_at) AS step FROM dict),
  fold AS (
    SELECT doc_id, CAST(0 AS BIGINT) AS step, text, '' AS pii_type, CAST(0 AS BIGINT) AS hits FROM n
    UNION ALL
    SELECT f.doc_id, r.step, replace(f.text, r.raw, r.token), r.pii_type, CAST((length(f.text) - length(replace(f.text, r.raw, ''))) / length(r.raw) AS BIGINT)
    FROM fold f JOIN ranked r ON r.doc_id = f.doc_id AND r.step = f.step + 1)
  SELECT pii_type, CAST(sum(hits) AS BIGINT) AS replaced FROM fold WHERE step > 0 AND hits > 0 GROUP BY pii_type"""
