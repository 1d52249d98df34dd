"""DuckDB SQL for the queries of this subpackage."""

P3_FOUND = """
WITH i AS (SELECT DISTINCT file, issue_id, impact, confidence FROM ai_issues
           WHERE file IS NOT NULL AND impact IS NOT NULL AND NOT isnan(impact) AND issue_id IS NOT NULL)
SELECT file, issue_id FROM i
QUALIFY row_number() OVER (PARTITION BY file ORDER BY impact DESC, confidence DESC NULLS LAST, issue_id) <= 3
"""

P6_FOUND = r"""
WITH RECURSIVE n AS (
  SELECT regexp_replace(regexp_replace(regexp_replace(replace(path_a, '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '^/', '') AS a,
         regexp_replace(regexp_replace(regexp_replace(replace(path_b, '\', '/'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '^/', '') AS b
  FROM ncd_candidates WHERE path_a IS NOT NULL AND path_b IS NOT NULL AND distance IS NOT NULL AND NOT isnan(distance) AND distance <= 0.4),
e AS (SELECT a, b FROM n WHERE a <> b UNION SELECT b, a FROM n WHERE a <> b),
r(path, g) AS (SELECT a, a FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.path)
SELECT path, min(g) AS group_path FROM r GROUP BY path
"""

P2_RUNS = r"""
b AS (SELECT DISTINCT block_id, path, start_line, string_split(source, chr(10)) AS l FROM blocks
      WHERE block_id IS NOT NULL AND path IS NOT NULL AND source IS NOT NULL AND start_line IS NOT NULL),
w AS (SELECT block_id, path, start_line, p, array_to_string(l[p:p + 5], chr(10)) AS t
      FROM (SELECT *, unnest(range(1, len(l) - 4)) AS p FROM b WHERE len(l) >= 6)),
k AS (SELECT t FROM w GROUP BY t HAVING min(path) <> max(path)),
s AS (SELECT DISTINCT block_id, start_line, unnest(range(p, p + 6)) AS n FROM w SEMI JOIN k USING (t)),
runs AS (SELECT block_id, start_line + min(n) - 1 AS first_line, start_line + max(n) - 1 AS last_line
      FROM (SELECT *, n - row_number() OVER (PARTITION BY block_id ORDER BY n) AS g FROM s) GROUP BY block_id, start_line, g)
"""

P2_FOUND = "WITH" + P2_RUNS + "SELECT * FROM runs"

P2_SHARES = "WITH" + P2_RUNS + """
SELECT b.block_id, len(b.l)::BIGINT AS lines, coalesce(x.n, 0)::BIGINT AS shared_lines, round(coalesce(x.n, 0) / len(b.l), 6) AS share
FROM b LEFT JOIN (SELECT block_id, sum(last_line - first_line + 1) AS n FROM runs GROUP BY 1) x USING (block_id)
"""

P8_WORDS = r"""
d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12)),
hits AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""

P8_FOUND = "WITH" + P8_WORDS + "SELECT * FROM hits"

P8_CLEAN = "WITH" + P8_WORDS + "SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM hits)"

P7_FOUND = r"""
WITH b AS (SELECT DISTINCT block_id, path, regexp_extract_all(source, '[A-Za-z0-9_$]+|[^\sA-Za-z0-9_$]') AS t FROM blocks
           WHERE block_id IS NOT NULL AND path IS NOT NULL AND source IS NOT NULL),
s AS (SELECT DISTINCT block_id, path, array_to_string(t[p:p + 2], chr(1)) AS g FROM (SELECT *, unnest(range(1, len(t) - 1)) AS p FROM b WHERE len(t) >= 3)),
n AS (SELECT block_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.block_id AS block_a, y.block_id AS block_b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.block_id < y.block_id AND x.path <> y.path GROUP BY 1, 2)
SELECT block_a, block_b FROM c JOIN n a ON a.block_id = block_a JOIN n b ON b.block_id = block_b WHERE k >= 0.7 * (a.n + b.n - k)
"""

P7_GROUPS = "WITH RECURSIVE" + P7_FOUND.replace("\nWITH", "", 1).replace("SELECT block_a, block_b FROM c", ", pair AS (SELECT block_a, block_b FROM c", 1) + """),
fp AS (SELECT block_id, md5(string_agg(g, chr(2) ORDER BY g)) AS fp FROM (SELECT DISTINCT block_id, g FROM s) GROUP BY 1),
k AS (SELECT block_id, min(block_id) OVER (PARTITION BY fp) AS class_id FROM fp),
e AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM pair JOIN k x ON x.block_id = block_a JOIN k y ON y.block_id = block_b WHERE x.class_id <> y.class_id),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(c, g) AS (SELECT a, a FROM u UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.c)
SELECT block_id, class_id, (SELECT count(*) FROM u WHERE a = class_id) AS links, coalesce((SELECT min(g) FROM r WHERE c = class_id), class_id) AS group_id FROM k
"""

P8_ITEMS = "WITH" + P8_WORDS + """,
dp AS (SELECT doc_id, p, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12)),
ip AS (SELECT item_id, p, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12)),
m AS (SELECT DISTINCT doc_id, item_id, dp.p, dp.p - ip.p AS diag FROM dp JOIN ip USING (g)),
runs AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY p) AS z FROM m) GROUP BY doc_id, item_id, diag, z)
SELECT item_id, count(DISTINCT doc_id) AS documents, max(n)::INT AS longest FROM runs GROUP BY item_id
"""

P8_PASSAGES = P8_ITEMS.replace("SELECT item_id, count(DISTINCT doc_id) AS documents, max(n)::INT AS longest FROM runs GROUP BY item_id", "SELECT doc_id, item_id, max(n)::INT AS words FROM runs GROUP BY doc_id, item_id")

P10_LIMITS = r"""
WITH once AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[-_\s]+', '_', 'g') AS source, length(text) AS chars, octet_length(encode(text)) AS bytes, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL),
u AS (SELECT source, 'chars' AS unit, chars AS length FROM once UNION ALL SELECT source, 'bytes', bytes FROM once),
c AS (SELECT source, unit, length, count(*) AS texts FROM u GROUP BY ALL),
r AS (SELECT *, (sum(texts) OVER (PARTITION BY source, unit ORDER BY length DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS at_risk, (sum(texts) OVER near - texts)::DOUBLE AS around FROM c WINDOW near AS (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING)),
e AS (SELECT *, (around + 0.5::DOUBLE) / (max(at_risk) OVER (PARTITION BY source, unit ORDER BY length RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) * 50) * at_risk AS expected FROM r),
p AS (SELECT *, CASE WHEN texts > expected THEN -(texts * ln(texts / expected) - texts + expected) ELSE 0 END AS log_p, count(*) OVER () AS tests FROM e),
k AS (SELECT *, row_number() OVER (ORDER BY log_p) AS k FROM p),
last AS (SELECT max(k) AS k FROM k WHERE log_p <= ln(0.01::DOUBLE) AND log_p <= ln(0.01::DOUBLE * k / tests))
SELECT source, unit, length::INT AS length, texts, at_risk, expected FROM k WHERE k <= (SELECT k FROM last)
"""

ORACLE = {"p10_limits": P10_LIMITS, "p2_found": P2_FOUND, "p2_shares": P2_SHARES, "p3_found": P3_FOUND, "p6_found": P6_FOUND, "p7_found": P7_FOUND, "p7_groups": P7_GROUPS, "p8_items": P8_ITEMS, "p8_passages": P8_PASSAGES, "p8_found": P8_FOUND, "p8_clean": P8_CLEAN}
