"""DuckDB SQL of those queries that SQL can express."""

from __future__ import annotations

from lodestar.llm.secrets import ALLOWED_BEFORE, ALLOWED_RUN, ALLOWED_WORDS, CANDIDATE, LEAST_BITS, WINDOW

PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {PLAIN}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, {PLAIN}) AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, list_slice(w, s, s + least(10, len(w)) - 1) AS win, least(10, len(w)) AS n FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(s)),
hits AS (SELECT doc_id, s, n, item_id FROM grams JOIN win USING (win, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, s, n FROM hits), unnest(range(s, s + n)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(4, len(w)) - 1), ' ') AS x FROM d, unnest(range(1, len(w) - least(4, len(w)) + 2)) t(s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (x) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, twoway.b FROM reach JOIN twoway ON reach.b = twoway.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""

_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_PATTERNS = {0: _ASSIGN, 1: "AKIA[A-Z0-9]+", 2: "[0-9a-f]+", 3: CANDIDATE}
_LEAST = {0: "length(regexp_extract(m, '" + _ASSIGN + "', 2)) >= 6", 1: "length(m) >= 20", 2: "length(m) >= 24"}
_BEFORE = ALLOWED_BEFORE.replace("'", "''")


def _matches(kind: int) -> str:
    """(doc_id, k, before, m, a, b): matches with the text since the last one and their code points."""
    p = _PATTERNS[kind]
    return (
        f"SELECT doc_id, {kind} AS k, before, m, (sum(length(before) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m))::BIGINT AS a, "
        f"(sum(length(before) + length(m)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS b FROM (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, "
        f"unnest(list_slice(pieces, 1, len(ms))) AS before, unnest(ms) AS m FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS pieces FROM d))"
    )


def _secrets() -> str:
    bits = f"list_max(list_transform(range(1, length(m) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr(m, i::INTEGER, {WINDOW}), ''), 'entropy')))"
    has = lambda p: f"regexp_matches(m, '[{p}]')"
    least = (
        f"CASE WHEN {has('0-9')} AND {has('a-z')} AND regexp_full_match(m, '[0-9a-f]+') THEN {LEAST_BITS['hex']} WHEN {has('0-9')} AND {has('a-z')} AND {has('A-Z')} THEN {LEAST_BITS['mixed']} "
        f"WHEN {has('0-9')} AND ({has('a-z')} OR {has('A-Z')}) THEN {LEAST_BITS['alnum']} WHEN {has('a-z')} AND {has('A-Z')} THEN {LEAST_BITS['letters']} END"
    )
    parts = (
        "SELECT doc_id, before, a, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS m, unnest(list_append(ws, '')) AS word FROM "
        f"(SELECT doc_id, before, a, string_split_regex(m, '{ALLOWED_WORDS}') AS ps, regexp_extract_all(m, '{ALLOWED_WORDS}') AS ws FROM runs)"
    )
    base = " UNION ALL ".join(f"SELECT doc_id, k, a, b FROM ({_matches(k)}) WHERE {_LEAST[k]}" for k in (0, 1, 2))
    names = "['assign', 'access', 'hex', 'entropy'][k + 1]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
runs AS (SELECT doc_id, before, a, m FROM ({_matches(3)}) WHERE NOT regexp_matches(m, '{ALLOWED_RUN}')),
parts AS ({parts}),
pieces AS (SELECT doc_id, 3 AS k, CASE WHEN i = 1 THEN before ELSE '' END AS before, m, (a + sum(length(m) + length(word)) OVER (PARTITION BY doc_id, a ORDER BY i) - length(m) - length(word))::BIGINT AS a FROM parts),
more AS (SELECT doc_id, k, a, a + length(m) AS b FROM pieces p WHERE length(m) >= {WINDOW} AND NOT regexp_matches(right(before, 40), '{_BEFORE}') AND {bits} >= {least} - 1e-9
AND NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = p.doc_id AND x.a <= p.a AND p.a + length(m) <= x.b)),
spans AS (SELECT doc_id, string_agg({names} || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg({names} || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS s FROM base GROUP BY doc_id)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(own.s, '')) AS base_sha256, coalesce(spans.s, '') AS spans
FROM d LEFT JOIN own USING (doc_id) LEFT JOIN spans USING (doc_id)
"""



ORACLES: dict[str, str] = {
    "op5_decontamination": DECONTAMINATION,
    "op6_near_dedup": NEAR_DEDUP,
    "op7_secrets": _secrets(),
}
