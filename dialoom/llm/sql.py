"""DuckDB SQL for the operators' queries that SQL can express by plain comparison of everything with everything."""

from __future__ import annotations

from .secret_scan import KINDS, LOOSE

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{0}')"

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, range(1, greatest(len(w) - 4, 1) + 1) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
          JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON r = a),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


def _found(no: int, kind: tuple) -> str:
    _, pattern, group, least = kind
    p = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, source, {no} AS kind, text, list_sum(list_transform(g[1:i], lambda z: length(z)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0)::BIGINT AS a, length(m[i]) AS n, v[i] AS v
      FROM (SELECT doc_id, source, text, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v FROM t), range(1, len(m) + 1) r(i) WHERE length(v[i]) >= {least}"""


SECRETS = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
base AS ({" UNION ALL ".join(_found(no, k) for no, k in enumerate(KINDS))}),
loose AS (SELECT * FROM ({_found(len(KINDS), LOOSE)}) l WHERE regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')
          AND NOT EXISTS (FROM base b WHERE b.doc_id = l.doc_id AND b.a < l.a + l.n AND l.a < b.a + b.n)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM loose),
owners AS (SELECT v, count(DISTINCT coalesce('s' || source, 'null')) AS owners, count(DISTINCT coalesce('s' || source, 'null') || ':' || coalesce(doc_id::VARCHAR, 'null')) AS repos FROM every GROUP BY v),
j AS (SELECT e.*, ['assign', 'access', 'hex', 'owned'][e.kind + 1] || ':' || a || ':' || (a + n) AS s, owners < 3 AND repos < 100 AS live FROM every e JOIN owners USING (v)),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
             string_agg(s, ',' ORDER BY a, kind) FILTER (kind < 3 OR live) AS spans, count(*) FILTER (kind < 3 AND live) AS n_live, count(*) FILTER (kind < 3 AND NOT live) AS n_example FROM j GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN g USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM h, range(0, length(h) // 2 - 99) r(p)),
f AS (SELECT s, min((doc_id, p)) AS f FROM w GROUP BY s HAVING count(*) > 1),
marked AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE (doc_id, p) > f.f),
fresh AS (SELECT *, CASE WHEN p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) + 100 THEN 1 ELSE 0 END AS new FROM marked),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS no FROM fresh) GROUP BY doc_id, no),
before AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head, max(b) AS last FROM before JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {WORDS.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, least(len(w), 13) AS n, w FROM (SELECT item_id, {WORDS.format(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM b, range(1, len(w) - n + 2) r(i)),
hits AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win), range(1, len(w) - n + 2) r(i)) JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
