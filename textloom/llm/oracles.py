"""DuckDB SQL of those queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((v >> {s}) & 31))::INT, 1)" for s in (15, 10, 5, 0))

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS h FROM p),
c AS (SELECT h, i, ('0x' || substr(h, (1 + 5 * i)::INT, 5))::BIGINT AS v FROM (SELECT DISTINCT h FROM d), range(8) r(i)),
b AS (SELECT h, string_agg({_BASE32}, '' ORDER BY i) AS payload_digest FROM c GROUP BY h),
m AS (SELECT h, max(page_id) AS best FROM d GROUP BY h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM d JOIN b USING (h) JOIN m USING (h)
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s : s + 12], ' ') AS x FROM i, range(1, 100000) r(s) WHERE len(w) > 0 AND s <= greatest(1, len(w) - 12)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
runs AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda s: {{'s': s, 'x': array_to_string(w[s : s + n - 1], ' ')}})) AS u FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, u.s AS s, win.n AS n, item FROM runs JOIN win ON runs.n = win.n AND runs.u.x = win.x),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
n AS (SELECT doc_id, i, raw, lower(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS x, row_number() OVER (ORDER BY doc_id, i) AS r FROM l),
d AS (SELECT x, min(r) AS r0 FROM n WHERE length(x) > 0 GROUP BY 1),
f AS (SELECT x, r0 FROM d WHERE length(x) >= 16),
v AS (SELECT x, r0, k, hash(substr(x, 1, k - 1) || substr(x, k + 1)) AS h FROM (SELECT x, r0, unnest(range(1, length(x) + 1)) AS k FROM f)),
p AS (SELECT a.x, a.r0, b.x AS y, b.r0 AS s FROM v a JOIN v b ON a.h = b.h AND a.k = b.k WHERE a.r0 > b.r0
  UNION ALL SELECT a.x, a.r0, b.x, b.r0 FROM v a JOIN f b ON a.h = hash(b.x) WHERE a.r0 > b.r0
  UNION ALL SELECT b.x, b.r0, a.x, a.r0 FROM v a JOIN f b ON a.h = hash(b.x) WHERE b.r0 > a.r0),
near AS (SELECT DISTINCT x FROM p WHERE levenshtein(x, y) <= 1),
m AS (SELECT n.doc_id, n.i, n.raw, d.r0 IS NOT NULL AND (n.r > d.r0 OR near.x IS NOT NULL) AS gone FROM n LEFT JOIN d ON n.x = d.x LEFT JOIN near ON n.x = near.x),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_dropped, count(*) FILTER (WHERE NOT gone) AS stay, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (WHERE gone), '') AS dropped_lines, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM m GROUP BY 1)
SELECT doc_id, n_dropped::BIGINT AS n_dropped, CASE WHEN n_dropped > 0 AND kept = '' THEN 0 ELSE stay END::BIGINT AS n_kept_or_blank, dropped_lines, sha256(kept) AS kept_sha256 FROM g
"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c, x) AS k FROM (SELECT *, count(*) OVER (PARTITION BY x) AS c FROM e)),
f AS (SELECT doc_id, n, x FROM o WHERE k <= n - (n * 80 + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
k AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS met, len(x.s) + len(y.s) AS total FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b),
g AS (SELECT a, b FROM k WHERE 100 * met >= 80 * (total - met)),
r AS (SELECT a AS doc_id, b AS t FROM g UNION SELECT b, a FROM g UNION SELECT r.doc_id, z.t FROM r JOIN (SELECT a AS z, b AS t FROM g UNION ALL SELECT b, a FROM g) z ON r.t = z.z),
m AS (SELECT doc_id, min(t) AS t FROM r GROUP BY 1)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(t, doc_id)) AS component_id, doc_id <= coalesce(t, doc_id) AS kept FROM s LEFT JOIN m USING (doc_id)
"""
