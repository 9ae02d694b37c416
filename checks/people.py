"""Tables that the checks derive from the given ones, in SQL that Spark and DuckDB both read.

The given tables hold no birth numbers, accounts or dates in text, and no nulls; these views do, and they grow with
`customer`.
"""

AS_OF = "2026-01-01"

# Shared digits: a day of birth (year 40..99, month 1..12, day 1..28) and a tail of four digits.
_BASE = """
SELECT c_custkey AS k, c_name, c_acctbal, c_nationkey,
       40 + (c_custkey * 7) % 60 AS yy, 1 + (c_custkey * 5) % 12 AS mm, 1 + (c_custkey * 11) % 28 AS dd,
       (c_custkey * 37) % 9000 AS tail
FROM customer
"""
# The last digit of the tail is shifted so that the number of ten digits is a multiple of 11 (if the shift is no 10).
_DIGITS = f"""
SELECT b.*, yy * 100000000 + mm * 1000000 + dd * 10000 + tail AS rc_number,
       (yy * 100000000 + mm * 1000000 + dd * 10000 + tail) % 11 AS rest
FROM ({_BASE}) b
"""
_TEXTS = f"""
SELECT d.*, lpad(CAST(yy AS string), 2, '0') || lpad(CAST(mm AS string), 2, '0') || lpad(CAST(dd AS string), 2, '0') AS ymd,
       CASE WHEN k % 2 = 0 AND rest > 0 THEN tail + 11 - rest ELSE tail END AS last4,
       lpad(CAST((k * 1237) % 1000 AS string), 3, '0') AS a3, lpad(CAST((k * 7919) % 1000 AS string), 3, '0') AS b3,
       lpad(CAST((k * 104729) % 1000 AS string), 3, '0') AS c3
FROM ({_DIGITS}) d
"""

PEOPLE = f"""
SELECT k AS person_id,
       CASE WHEN k % 7 = 0 THEN NULL
            WHEN k % 11 = 0 THEN '  user' || CAST(k % 500 AS string) || '@example.com '
            ELSE 'user' || CAST(k % 500 AS string) || '@example.com' END AS email,
       CASE WHEN k % 13 = 0 THEN '77' || a3 || b3
            WHEN k % 5 = 0 THEN '(02) ' || a3 || '-' || b3 || '-' || c3
            ELSE '+420 6' || substr(a3, 2, 2) || ' ' || b3 || ' ' || c3 END AS telefon,
       CASE WHEN k % 9 = 0 THEN ymd || lpad(CAST(last4 AS string), 4, '0')
            WHEN k % 17 = 0 THEN ymd || '/' || a3
            ELSE ymd || '/' || lpad(CAST(last4 AS string), 4, '0') END AS rodne_cislo,
       CASE WHEN k % 6 = 0 THEN '' ELSE 'CZ' || lpad(CAST(k % 97 AS string), 2, '0') || '0800' ||
            lpad(CAST(k AS string), 16, '0') END AS iban,
       CASE WHEN k % 4 = 0 THEN '19-' ELSE '' END || CAST(2000145399 + k % 50 AS string) || '/0800' AS ucet,
       CASE WHEN k % 10 = 0 THEN '31.02.19' || CAST(yy AS string)
            WHEN k % 3 = 0 THEN '19' || CAST(yy AS string) || '-' || lpad(CAST(mm AS string), 2, '0') || '-' || lpad(CAST(dd AS string), 2, '0')
            WHEN k % 3 = 1 THEN CAST(dd AS string) || '.' || CAST(mm AS string) || '.' || CAST(1960 + k % 66 AS string)
            ELSE lpad(CAST(dd AS string), 2, '0') || '/' || lpad(CAST(mm AS string), 2, '0') || '/20' || lpad(CAST(k % 30 AS string), 2, '0') END AS date_of_birth,
       '19' || CAST(yy AS string) || '-01-02' AS created_at,
       CASE WHEN k % 2 = 0 THEN '19' || CAST(yy AS string) || '-06-01' ELSE '2024-06-0' || CAST(1 + k % 9 AS string) END AS event_date,
       CASE WHEN k % 17 = 0 THEN 'user' || CAST(k % 500 AS string) || '@example.com' ELSE c_name END AS name,
       CASE WHEN c_nationkey % 3 = 0 THEN '110 00' ELSE 'Praha' END AS city,
       CASE WHEN k % 4 = 0 THEN 'Dlouhá č.p. 12'
            WHEN k % 4 = 1 THEN 'Brno 602 00, pan Novák'
            WHEN k % 4 = 2 THEN 'pište na user' || CAST(k % 500 AS string) || '@example.com. Díky'
            ELSE 'bez údajů' END AS note,
       CAST(600000000 + (k * 7919) % 99999999 AS double) AS phone_num,
       CASE WHEN k % 8 = 0 THEN NULL ELSE c_acctbal END AS balance,
       k % 3 = 0 AS active,
       'C' || lpad(CAST(k AS string), 6, '0') AS customer_id
FROM ({_TEXTS}) t
"""

# One text per person: a value that repeats on another line, a number of ten digits that is a phone and maybe a birth
# number, and line ends of three kinds.
NOTES = f"""
SELECT person_id AS doc_id,
       note || chr(10) || telefon || chr(13) || chr(10) || 'RČ ' || rodne_cislo || chr(10)
       || 'narozen(a) ' || date_of_birth || ', ' || event_date || chr(11) || 'účet ' || ucet || ' ' || iban || chr(10)
       || replace(rodne_cislo, '/', '') || chr(10) || coalesce(email, '-') || ' ' || telefon || chr(10) AS text
FROM ({PEOPLE}) p
"""
