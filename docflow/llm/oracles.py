"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
k AS (SELECT *, CASE WHEN i <= n - 49 THEN md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS k FROM e),
l AS (SELECT *, k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id AS late FROM k),
g AS (SELECT *, max(CASE WHEN late THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM l),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM g),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM s GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans FROM w LEFT JOIN r USING (doc_id)
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
c AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + 12], ' ') AS k FROM c),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT doc_id, i, 13 AS n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k FROM e
 UNION ALL SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win WHERE n < 13) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT p.doc_id, p.i, p.n, win.item_id FROM p JOIN win ON p.n = win.n AND p.k = win.k),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS x FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

PROXIMITY = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id::VARCHAR AS item, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT p.* FROM p SEMI JOIN b USING (word)),
n AS (SELECT word, count(*) AS n FROM k GROUP BY word),
r AS (SELECT item, word, row_number() OVER (PARTITION BY item ORDER BY n, word) AS r FROM b JOIN n USING (word)),
pair AS (SELECT x.item, x.word AS a, y.word AS b FROM r x JOIN r y USING (item) WHERE x.r = 1 AND y.r = 2)
SELECT item, x.doc_id, count(*)::BIGINT AS n_near, min(abs(x.i - y.i))::INT AS nearest FROM pair JOIN k x ON x.word = a JOIN k y ON y.word = b AND y.doc_id = x.doc_id WHERE abs(x.i - y.i) <= 8 GROUP BY item, x.doc_id
"""

OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
f AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS k FROM e),
s AS (SELECT DISTINCT doc_id, md5(k) AS k FROM f WHERE i <= n - 4 OR (n < 5 AND i = 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.c::BIGINT AS component_id, m.c = doc_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN z USING (doc_id)
"""

OP10 = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, h, length(h) // 2 AS n, unnest(generate_series(0, length(h) // 2 - 1)) AS i FROM h WHERE h <> ''),
k AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN i <= n - 100 THEN md5(substr(h, 2 * i + 1, 200)) END AS k FROM e),
l AS (SELECT doc_id, i, b, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS late FROM k),
g AS (SELECT *, max(CASE WHEN late THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM l),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM g),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS t FROM s GROUP BY doc_id)
SELECT h.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM h LEFT JOIN r USING (doc_id)
"""

OP11 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
f AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k FROM e),
s AS (SELECT DISTINCT doc_id, md5(k) AS k FROM f WHERE i <= n - 2 OR (n < 3 AND i = 1)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
m AS (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a),
t AS (SELECT a AS doc_id, count(*) AS n FROM u GROUP BY a)
SELECT doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, m.c::BIGINT AS component_id, coalesce(t.n, 0)::BIGINT AS n_links FROM d JOIN m USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN t USING (doc_id)
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(u[1 : a], '') AS x, array_to_string(u[a + 1 : b], '') AS y, array_to_string(u[b + 1 :], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(x || y || z) AS restored_sha256 FROM p
"""

OP13 = rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, y: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT id, run, count(*) AS c FROM runs GROUP BY ALL),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(id || ':' || run)), '..'), lambda b: ('0x' || b)::BIGINT)), lambda x, b: xor(steps[1 + xor(x, b) % 256], x // 256))) AS h FROM r, crc),
f AS (SELECT CASE WHEN h % 31 = 0 THEN run[: (h % length(run))] || run[h % length(run) + 2 :] ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM f WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
e AS (SELECT word, i, word[: i] || word[i + 2 :] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT a.word AS a, b.word AS b FROM e a JOIN e b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT e.word, w.word FROM e JOIN w ON e.rest = w.word UNION SELECT w.word, e.word FROM e JOIN w ON e.rest = w.word),
k AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS m FROM near JOIN w ON w.word = b GROUP BY a),
o AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN b END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN k ON a = word),
t(word, root) AS (SELECT word, word FROM o UNION SELECT t.word, o.form FROM t JOIN o ON o.word = t.root WHERE o.form IS NOT NULL),
l AS (SELECT t.word, t.root FROM t JOIN o ON o.word = t.root WHERE o.form IS NULL)
SELECT o.word, n, n_near, form, form_n, root FROM o JOIN l USING (word)
"""

ORACLES = {"op1_substring_dedup": OP1, "op5_decontamination": OP5, "benchmark_proximity": PROXIMITY, "op8_minhash_dedup": OP8, "op10_run_dedup": OP10, "op11_ngram_join": OP11, "op12_fill_middle": OP12, "op13_spelling": OP13}
