"""DuckDB SQL for the queries that SQL can express over whole tables."""

OP2 = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owned AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS lost FROM keyed k LEFT JOIN owned o USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE lost)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages
), g AS (SELECT digest, max(page_id) AS last FROM p WHERE size >= 1000 GROUP BY digest)
SELECT page_id, size::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN last IS NOT NULL AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest AND p.size >= 1000
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), w AS (
  SELECT DISTINCT item_id, list_slice(words, s, least(s + 9, len(words))) AS win, least(10, len(words)) AS n
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS s FROM b WHERE len(words) > 0)
), lens AS (SELECT DISTINCT n FROM w), hits AS (
  SELECT p.doc_id, p.s, w.n, w.item_id
  FROM (SELECT doc_id, n, unnest(range(1, len(words) - n + 2)) AS s, words FROM d, lens WHERE len(words) >= n) p
  JOIN w ON w.n = p.n AND w.win = list_slice(p.words, p.s, p.s + p.n - 1)
), places AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS pos FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id),
wins AS (SELECT row_number() OVER () AS k, win, len(list_distinct(win)) AS m FROM (SELECT DISTINCT win FROM w) WHERE len(list_distinct(win)) > 3),
wterms AS (SELECT k, m, unnest(list_distinct(win)) AS term FROM wins),
occ AS (SELECT doc_id, unnest(words) AS term, unnest(range(len(words))) AS pos FROM d),
met AS (SELECT k, m, doc_id, pos, term FROM occ JOIN wterms USING (term)),
blocks AS (SELECT k, doc_id, b, count(DISTINCT term) AS c, m FROM (SELECT k, m, doc_id, term, pos // 14 AS b FROM met) GROUP BY ALL),
dense AS (SELECT DISTINCT x.k, x.doc_id FROM blocks x LEFT JOIN blocks y ON y.k = x.k AND y.doc_id = x.doc_id AND y.b = x.b + 1 WHERE x.c + coalesce(y.c, 0) >= x.m - 2),
close AS (SELECT DISTINCT x.k, x.doc_id, x.pos, x.m, y.term FROM met x JOIN dense USING (k, doc_id) JOIN met y ON y.k = x.k AND y.doc_id = x.doc_id AND y.pos BETWEEN x.pos AND x.pos + 13),
runs AS (SELECT DISTINCT k, doc_id FROM (SELECT k, doc_id, pos, m, count(*) AS c FROM close GROUP BY ALL) WHERE c >= m - 2),
nn AS (SELECT doc_id, count(*) AS n_near, string_agg(i, ',' ORDER BY i) AS near_ids FROM (SELECT DISTINCT doc_id, w.item_id::VARCHAR AS i FROM runs JOIN wins USING (k) JOIN w USING (win)) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near_items, sha256(coalesce(near_ids, '')) AS near_items_sha256
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id) LEFT JOIN nn USING (doc_id)
"""

OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), u AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS r4 FROM t
), f AS (
  SELECT *, least(c1, c2) AS p, greatest(c1, c2) AS q,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r3 >= 90 THEN 'plain'
              WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), parts AS (SELECT *, substr(text, 1, p) AS a, substr(text, p + 1, q - p) AS m, substr(text, q + 1) AS z FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m WHEN 'spm' THEN '<S>' || z || '<P>' || a || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

ORACLES = {"op2_line_dedup": OP2, "op8_warc": OP8, "op10_decontamination": OP10, "op11_fim": OP11}
