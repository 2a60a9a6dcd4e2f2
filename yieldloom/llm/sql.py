"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from yieldloom.llm import jaccard, quality, templates

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM met WHERE 100 * c >= {jaccard.PERCENT} * (n + m - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""

HOST_QUALITY = f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '{WORD}') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM docs),
windows AS (SELECT row, i, array_to_string(w[i:i+{quality.WINDOW - 1}], ' ') AS g FROM (SELECT row, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM worded)),
again AS (SELECT row, unnest(range(i, i + {quality.WINDOW})) AS pos FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM windows) WHERE c > 1),
repeated AS (SELECT row, count(DISTINCT pos) AS n FROM again GROUP BY 1),
measured AS (SELECT doc_id, host, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words FROM worded LEFT JOIN repeated USING (row)),
ruled AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM measured),
hosts AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS f FROM ruled GROUP BY 1),
moments AS (SELECT avg(f / n) AS m, coalesce(var_pop(f / n), 0) AS v, avg(1 / n) AS c FROM hosts),
prior AS (SELECT m, CASE WHEN v - c * m * (1 - m) > 0 THEN least(greatest(m * (1 - m) / (v - c * m * (1 - m)) - 1, {quality.WEAKEST}), {quality.STRONGEST}) ELSE {quality.STRONGEST} END AS k FROM moments),
bad AS (SELECT host, (f + m * k) / (n + k) >= {quality.BAD_HOST} AS host_bad FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_bad,
    NOT base_failed AND NOT (host_bad AND (100 * n_symbols > {quality.STRICT_SYMBOLS} * word_chars OR 100 * n_repeat_words > {quality.STRICT_REPEATED} * n_words
        OR 100 * n_dup_lines > {quality.STRICT_LINES} * n_words)) AS kept
FROM ruled JOIN bad USING (host)
"""

_NOISE = templates.NOISE.replace("'", "''")
_EDGES = templates.EDGES.replace("'", "''")
_UNITS = ", ".join(f"'{u}'" for u in templates.UNITS)
_BARE = f"trim({{}}, '{_EDGES}')"
_PLAIN, _BEFORE = _BARE.format("w[i]"), _BARE.format("w[i-1]")
_TOKEN = f"""CASE WHEN regexp_matches({_PLAIN}, '{templates.NUMBER}') THEN '{templates.NUM}'
    WHEN i > 1 AND regexp_matches({_BEFORE}, '{templates.NUMBER}') AND lower({_PLAIN}) IN ({_UNITS}) THEN '{templates.UNIT}'
    WHEN i > 1 AND regexp_matches({_PLAIN}, '{templates.NAME}') AND NOT regexp_matches(w[i-1], '{templates.SENTENCE_END}') THEN '{templates.PERSON}'
    ELSE lower({_PLAIN}) END"""
_KINDS = f"('{templates.NUM}', '{templates.UNIT}', '{templates.PERSON}')"


def _windows(name: str, table: str, key: str, size: str) -> str:
    return f"""{name}_words AS (SELECT DISTINCT {key}, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '{_NOISE}', ' ', 'g'), '{templates.SPACE}'), lambda x: x <> '') AS w FROM {table}),
{name}_tokens AS (SELECT {key}, w, list_transform(range(1, len(w) + 1), lambda i: {_TOKEN}) AS t FROM {name}_words),
{name}_windows AS (SELECT DISTINCT {key}, pos, size, t[pos:pos+size-1] AS t, list_transform(w[pos:pos+size-1], lambda x: lower({_BARE.format("x")})) AS w
    FROM (SELECT {key}, w, t, size, unnest(range(1, len(w) - size + 2)) AS pos FROM (SELECT {key}, w, t, {size} AS size FROM {name}_tokens) WHERE size > 0))"""


TEMPLATES = f"""
WITH {_windows("item", "benchmark", "item_id", f"least({templates.WINDOW}, len(w))")},
asked AS (SELECT * FROM item_windows WHERE len(list_filter(t, lambda x: x NOT IN {_KINDS} AND x <> '')) >= CASE WHEN size = {templates.WINDOW} THEN {templates.LEAST_LITERAL} ELSE size // 2 + 1 END),
counted AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS windows FROM asked),
{_windows("doc", "documents", "doc_id", "unnest((SELECT list(DISTINCT size) FROM asked))")},
met AS (SELECT doc_id, item_id, d.pos - a.pos AS shift, windows, a.t AS t, a.w AS was, d.w AS now FROM doc_windows d JOIN counted a ON d.t = a.t),
shifts AS (SELECT doc_id, item_id, shift, windows, count(*) AS n,
    list_distinct(flatten(list(list_filter(list_transform(range(1, len(t) + 1), lambda k: {{'kind': t[k], 'was': was[k], 'now': now[k]}}), lambda s: s.kind IN {_KINDS})))) AS slots
    FROM met GROUP BY ALL),
judged AS (SELECT * FROM (SELECT doc_id, item_id, shift, windows, n, slots FROM shifts)
    WHERE len(list_distinct(list_transform(slots, lambda s: {{'kind': s.kind, 'was': s.was}}))) = len(slots) AND n >= least({templates.LEAST_WINDOWS}, windows))
SELECT doc_id, item_id, n AS n_windows, windows AS n_item_windows, len(slots) AS n_slots, len(list_filter(slots, lambda s: s.was <> s.now)) AS n_changed
FROM judged QUALIFY row_number() OVER (PARTITION BY doc_id, item_id
    ORDER BY n DESC, windows DESC, len(slots) DESC, len(list_filter(slots, lambda s: s.was <> s.now)) DESC, shift) = 1
"""
