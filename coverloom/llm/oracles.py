"""DuckDB SQL for the queries that SQL expresses, written from the contracts and not from the operators."""

from __future__ import annotations

import string

from ._license_texts import DIGESTS, NOTICE_FORMS, NOTICE_NAMES, TEXTS, TITLES

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + 9), ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, (SELECT DISTINCT n FROM wins) sizes WHERE len(w) >= n)),
met AS (SELECT DISTINCT doc_id, grams.n, s, item_id FROM grams JOIN wins ON wins.n = grams.n AND wins.k = grams.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# of a text's lines, those that begin with a copyright sign, or with the word and a year, a sign or a form field, go
_NOTICE = r"^[^a-z0-9]*(copyright[^a-z0-9]*(\(c\)|©|[0-9]{4}|[\[<{])|\(c\)[^a-z0-9]*(copyright|[0-9]{4})|©|all rights reserved)"
_SPELLINGS = {"licence": "license", "organisation": "organization", "merchantibility": "merchantability", "favour": "favor", "fulfil ": "fulfill ", "sub license": "sublicense", "non infringement": "noninfringement", "https ": "http "}


def _spelled(words: str) -> str:
    for a, b in _SPELLINGS.items():
        words = f"replace({words}, {_quoted(a)}, {_quoted(b)})"
    return words


def _lines(text: str) -> str:
    """The canonical lines of a text; spellings may reach over what stood between two words, not over line ends."""
    kept = f"list_transform(string_split(lower(coalesce({text}, '')), chr(10)), lambda l: CASE WHEN regexp_matches(l, {_quoted(_NOTICE)}) THEN '' ELSE l END)"
    return "list_transform(" + kept + ", lambda l: " + _spelled("regexp_replace(l, '[^\\p{L}\\p{N}]+', ' ', 'g')") + ")"


_BODY = "trim(regexp_replace(array_to_string({0}, ' '), ' +', ' ', 'g'))"
_KNOWN = ", ".join(
    [f"({_quoted(k)}, {_quoted(t)}, TRUE)" for k, t in TEXTS.items()]
    + [f"({_quoted(k)}, {_quoted(title)} || chr(10) || {_quoted(t)}, TRUE)" for k, t in TEXTS.items() for title in TITLES[k]]
    + [f"({_quoted(k)}, {_quoted(f.format(n))}, FALSE)" for k, names in NOTICE_NAMES.items() for n in names for f in NOTICE_FORMS]
)
_DIGESTS = ", ".join(f"({_quoted(d)}, TRUE, {_quoted(k)})" for d, k in DIGESTS.items())

LICENSE_SCAN = f"""
WITH known AS (SELECT digest, whole, min(id) AS license_id FROM (
    SELECT sha256({_BODY.format(_lines('t'))}) AS digest, whole, id FROM (VALUES {_KNOWN}) v(id, t, whole)
    UNION ALL SELECT * FROM (VALUES {_DIGESTS}) d(digest, whole, id)) GROUP BY 1, 2),
docs AS (SELECT doc_id, {_lines('text')} AS lines FROM documents),
lines AS (SELECT doc_id, license_id FROM (SELECT doc_id, trim(unnest(lines)) AS line FROM docs) JOIN known ON NOT whole AND digest = sha256(line) WHERE line <> ''),
named AS (SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices FROM lines GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_BODY.format('lines')}) AS digest FROM docs)
SELECT w.doc_id, w.digest, k.license_id, coalesce(n, 0) AS n_notice_lines, coalesce(notices, '') AS notices
FROM whole w LEFT JOIN known k ON k.whole AND k.digest = w.digest LEFT JOIN named ON named.doc_id = w.doc_id"""


_LIMITS = {5: 0.15, 6: 0.14, 8: 0.12, 10: 0.10}


def _quality() -> str:
    space = "\\x20\\x09-\\x0D"
    parts = [f"""d AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars
        FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{space}]+') AS w FROM documents))"""]
    for n in _LIMITS:
        parts += [
            f"g{n} AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS c, row_number() OVER (PARTITION BY doc_id, g ORDER BY s) AS r FROM (SELECT doc_id, s, array_to_string(list_slice(w, s, s + {n - 1}), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS s FROM d WHERE len(w) >= {n})))",
            f"c{n} AS (SELECT doc_id, sum(length(w[p])) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(s, s + {n})) AS p FROM g{n} WHERE r > 1) JOIN d USING (doc_id) GROUP BY doc_id)",
        ]
    parts += [
        "again AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 8)) AS p FROM g8 WHERE c > 1) GROUP BY doc_id)",
        f"""lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS r, list_sum(list_transform(regexp_extract_all(line, '[^{space}]+'), lambda x: length(x))) AS chars
        FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{space}]'))""",
        "dups AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r > 1) AS n_dup, coalesce(sum(chars) FILTER (r > 1), 0) AS dup_chars FROM lines GROUP BY doc_id)",
        f"""m AS (SELECT d.doc_id, n_words, word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
            CAST(coalesce(n_dup, 0) AS DOUBLE) / greatest(coalesce(n_lines, 0), 1) AS dup_line_share, CAST(coalesce(dup_chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS dup_line_char_share,
            {", ".join(f"CAST(coalesce(c{n}.chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS dup_{n}gram_share" for n in _LIMITS)}
            FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN again USING (doc_id) {" ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = d.doc_id" for n in _LIMITS)})""",
    ]
    failed = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
    limits = " AND ".join(f"dup_{n}gram_share <= {x}" for n, x in _LIMITS.items())
    return "WITH " + ",\n".join(parts) + f"\nSELECT *, {failed} AS base_failed, NOT {failed} AND dup_line_share <= 0.30 AND dup_line_char_share <= 0.20 AND {limits} AS kept FROM m"


QUALITY_RULES = _quality()

_LOWERED = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+')"

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, node = root AS kept FROM roots LEFT JOIN sizes ON doc_id = node"""

SUFFIX_DEDUP = f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
g AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
occ AS (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS c, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM g),
cover AS (SELECT doc_id, p, bool_or(r > 1) AS later FROM (SELECT doc_id, r, unnest(range(s, s + 50)) AS p FROM occ WHERE c > 1) GROUP BY doc_id, p),
runs AS (SELECT doc_id, p, later, p - row_number() OVER (PARTITION BY doc_id, later ORDER BY p) AS run FROM cover)
SELECT doc_id, CAST(min(p) - 1 AS INT) AS start, CAST(max(p) AS INT) AS "end", CAST(count(*) AS INT) AS n_words, later FROM runs GROUP BY doc_id, later, run"""
