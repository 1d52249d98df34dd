"""DuckDB SQL for the queries of core_queries."""

from __future__ import annotations

from codeloom.functions.predicates import TEST_FIXTURE_ENDS, TEST_FIXTURE_PARTS
from codeloom.operators.clones import WINDOWS
from codeloom.operators.summary import AT_RISK, SCORED
from codeloom.sources.scan import LANGUAGES, SKIPPED_DIRS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def word_list(xs) -> str:
    return "(" + ", ".join(quoted(x) for x in xs) + ")"


P1_FOUND = r"""
WITH ok AS (SELECT DISTINCT run_id, cutoff_at FROM cache_runs WHERE status = 'succeeded'),
r AS (SELECT run_id, cutoff_at, lag(run_id) OVER (ORDER BY run_id) AS prev FROM ok),
e AS (SELECT DISTINCT entry_id, path, scanned_at, arrived_at,
        regexp_replace(lower(trim(hash)), '^sha256:', '') || '#' ||
        coalesce(array_to_string(list_sort(list_distinct(dep_targets)), chr(0)), '') AS fp
      FROM cache_entries WHERE hash IS NOT NULL AND path IS NOT NULL),
s AS (SELECT run_id, prev, path, fp FROM (
        SELECT r.run_id, r.prev, e.path, e.fp,
               row_number() OVER (PARTITION BY r.run_id, e.path ORDER BY e.scanned_at DESC, e.entry_id DESC) AS k
        FROM r JOIN e ON e.arrived_at <= r.cutoff_at) WHERE k = 1)
SELECT c.run_id, c.path FROM s c LEFT JOIN s p ON p.run_id = c.prev AND p.path = c.path
WHERE p.fp IS DISTINCT FROM c.fp
"""

LATEST = """latest AS (SELECT * FROM (SELECT DISTINCT path, entry_id, dep_targets, external_specs, loc, scanned_at FROM cache_entries WHERE path IS NOT NULL AND hash IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC NULLS LAST, entry_id DESC) = 1),
edge AS (SELECT DISTINCT path AS source, target FROM (SELECT path, unnest(dep_targets) AS target FROM latest) WHERE target IS NOT NULL)"""

REACH = "reach(node) AS (SELECT path FROM latest WHERE path LIKE '%/tests/%' UNION SELECT e.target FROM edge e JOIN reach r ON e.source = r.node)"

DEAD_NODES = f"""WITH RECURSIVE {LATEST}, {REACH}
SELECT path, coalesce(loc, 0)::BIGINT AS lines_of_code, 0.95::DOUBLE AS confidence, 'not reachable from any entry point' AS reason FROM latest WHERE path NOT IN (SELECT node FROM reach)"""

SEEDED_DEAD = f"""WITH RECURSIVE {LATEST}, {REACH}
SELECT path, coalesce(loc, 0)::BIGINT AS lines_of_code, 0.7::DOUBLE AS confidence, 'implicit entry point not reachable from runtime' AS reason FROM latest
WHERE path LIKE '%/scripts/%' AND path NOT IN (SELECT node FROM reach) AND regexp_matches(path, '^[^/]+/(src|__mocks__|scripts)/') AND NOT regexp_matches(path, '\\.(test|spec)\\.')"""

CYCLES = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer),
e AS (SELECT c_custkey::VARCHAR AS a, ((c_custkey * 7 + 3) % n)::VARCHAR AS b FROM customer, n WHERE c_custkey <> (c_custkey * 7 + 3) % n),
w(start, node, path) AS (SELECT a, b, [a] FROM e UNION ALL SELECT w.start, e.b, list_append(w.path, w.node) FROM w JOIN e ON e.a = w.node WHERE w.node <> w.start AND NOT list_contains(w.path, w.node) AND len(w.path) < 200)
SELECT array_to_string(path, '>') AS cycle FROM w WHERE node = start AND start = list_min(path)"""

COMPONENTS = f"""WITH RECURSIVE {LATEST}, u AS (SELECT source AS a, target AS b FROM edge WHERE source <> target UNION SELECT target, source FROM edge WHERE source <> target),
r(name, g) AS (SELECT a, a FROM u UNION SELECT u.b, r.g FROM r JOIN u ON u.a = r.name) SELECT name, min(g) AS least FROM r GROUP BY name"""

NEIGHBOURS = f"""WITH {LATEST}, c AS (SELECT DISTINCT path FROM files WHERE language = 'python')
SELECT path FROM c UNION SELECT target FROM edge SEMI JOIN c ON source = path UNION SELECT source FROM edge SEMI JOIN c ON target = path"""

SCRIPTS = "('typescript', 'tsx', 'javascript', 'jsx')"
SRC = "src AS (SELECT DISTINCT path, language, source FROM files WHERE source IS NOT NULL)"
LINE = SRC + r""", line AS (SELECT path, language, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (
  SELECT path, language, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT path, language, string_split(regexp_replace(source, '\r\n', chr(10), 'g'), chr(10)) AS l FROM src)))"""
TRIMMED = r"regexp_replace(regexp_replace(text, '^[\s\x{85}\x{a0}]+', ''), '[\s\x{85}\x{a0}]+$', '')"

UNUSED_DEPS = f"""WITH {LATEST}, p AS (SELECT DISTINCT path, CASE WHEN s LIKE '@%' THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE split_part(s, '/', 1) END AS package FROM (SELECT path, unnest(external_specs) AS s FROM latest)),
m AS (SELECT DISTINCT path, CASE WHEN s LIKE '@%' THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE split_part(s, '/', 1) END AS package FROM (SELECT path, unnest(external_specs) AS s FROM cache_entries WHERE run_id <= 2))
"""

LINE_METRICS = f"""WITH {LINE} SELECT s.path, coalesce(m.loc, 0)::BIGINT AS loc, coalesce(m.n, 0)::BIGINT AS total_lines FROM src s LEFT JOIN
(SELECT path, count(*) AS n, count(*) FILTER (WHERE {TRIMMED} <> '' AND NOT starts_with({TRIMMED}, '//')) AS loc FROM line GROUP BY path) m USING (path)"""

TEST_FILE = r"regexp_matches(lower(path), '(^|/)(tests|test|__tests__|fixtures)/|\.(test|spec)\.')"
SCRIPT_FILE = "regexp_matches(lower(path), '/(examples|example|scripts|server|cli|bin|migrations|tools)/|gulpfile|gruntfile')"
COMMENT = r"regexp_matches(text, '^\s*(//|\*|/\*)')"


def rule_sql(r) -> str:
    hits = " OR ".join(f"contains(text, {quoted(n)})" for n in r.needles)
    if r.macro:
        bare = r"""regexp_replace(regexp_replace(text, 'r"[^"]*"', '', 'g'), '"(?:[^"\\]|\\.)*(?:"|$)', '', 'g')"""
        hits = f"regexp_matches({bare}, '(^|[^A-Za-z0-9_])' || regexp_escape({quoted(r.needles[0])}))"
    where = f"({hits})"
    tail = f"substr(text, strpos(text, {quoted(r.needles[0])}))" if r.after_needle else "text"
    for x in r.exclusions:
        where += f" AND NOT contains({tail}, {quoted(x)})"
    if r.rule == "rust-panic":
        where += r" AND NOT regexp_matches(split_part(text, 'panic!(', 1), 'unwrap_or_else\(|ok_or_else\(')"
    where += f" AND {'' if r.comment else 'NOT '}{COMMENT}"
    if r.family != "any":
        where += r" AND regexp_matches(path, '\.(ts|tsx|js|jsx)$')" if r.family == "js" else r" AND regexp_matches(path, '\.rs$')"
    if r.skip_examples:
        where += f" AND NOT {SCRIPT_FILE}"
    return f"SELECT path AS file, line::BIGINT AS line, {quoted(r.rule)} AS rule, {quoted(r.severity)} AS severity, {r.confidence}::DOUBLE AS confidence FROM line WHERE NOT {TEST_FILE} AND {where}"


LOOKAHEAD = """SELECT event_id, user_id FROM (SELECT *, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS a FROM events)
WHERE event_type = 'error' AND coalesce(a, 0) = 0"""

NORMAL = r"trim(regexp_replace(translate(regexp_replace({0}, '(/\*(?:[^*]|\*+[^*/])*(?:\*+/|\**$))|(//[^\n]*)', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\s\x{85}\x{a0}]+', ' ', 'g'))"

NORMAL_TEXT = NORMAL.replace("{0}", "text")

FINGERPRINTS = """
tok AS (SELECT id, list_filter(string_split({normal}, ' '), lambda x: x <> '') AS t FROM {frm}),
gram AS (SELECT id, CASE WHEN len(t) < 8 THEN []::VARCHAR[] ELSE list_transform(range(1, len(t) - 6), lambda i: md5(array_to_string(t[i:i + 7], ' '))) END AS g FROM tok),
fps AS (SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(len(g) - 3, 1) + 1), lambda i: list_min(g[i:i + 3])))) AS f FROM gram WHERE len(g) > 0),
cls AS (SELECT array_to_string(f, ',') AS fp, min(id) AS class, any_value(f) AS f FROM fps GROUP BY 1),
member AS (SELECT fps.id, cls.class FROM fps JOIN cls ON array_to_string(fps.f, ',') = cls.fp),
one AS (SELECT class, unnest(f) AS x, len(f) AS n FROM cls),
pair AS (SELECT p.class AS a, q.class AS b, count(*) AS k, any_value(p.n) AS n, any_value(q.n) AS m FROM one p JOIN one q ON p.x = q.x AND p.class < q.class GROUP BY 1, 2),
close AS (SELECT a, b, k / (n + m - k) AS similarity FROM pair WHERE k >= 0.7 * (n + m - k))"""

BLOCK = "blk AS (SELECT DISTINCT block_id AS id, path, name, start_line, end_line, source FROM blocks), big AS (SELECT DISTINCT id, source FROM blk WHERE end_line - start_line + 1 >= 5 AND source IS NOT NULL)," + FINGERPRINTS.format(normal=NORMAL.replace("{0}", "source"), frm="big")
BLOCK_CLONES = f"WITH {BLOCK} SELECT a, b, round(similarity * 100) / 100 AS confidence FROM close"
BLOCK_MEMBERS = f"WITH {BLOCK} SELECT id, class AS class_id FROM member"

ISSUE = BLOCK + """,
place AS (SELECT id, any_value(path) AS file, any_value(start_line) AS s, any_value(end_line) AS e FROM blk GROUP BY id),
copies AS (SELECT m.class, p.file, p.id FROM member m JOIN place p USING (id)),
ends AS (SELECT class, arg_min(file, (file, id)) AS lof, arg_min(id, (file, id)) AS loi, arg_max(file, (file, id)) AS hif, arg_max(id, (file, id)) AS hii FROM copies GROUP BY class),
near AS (SELECT a AS class, b AS other FROM close UNION ALL SELECT b, a FROM close UNION ALL SELECT class, class FROM ends WHERE lof <> hif),
link AS (SELECT DISTINCT least(id, o) AS a, greatest(id, o) AS b FROM (SELECT c.id, CASE WHEN c.file <> e.lof THEN e.loi WHEN c.file <> e.hif THEN e.hii END AS o FROM near n JOIN copies c ON c.class = n.class JOIN ends e ON e.class = n.other) WHERE o IS NOT NULL),
issue AS (SELECT row_number() OVER (ORDER BY l.a, l.b) AS i, x.file AS fa, x.s AS sa, x.e AS ea, y.file AS fb, y.s AS sb, y.e AS eb, least(x.e - x.s, y.e - y.s) + 1 AS span
  FROM link l JOIN place x ON x.id = l.a JOIN place y ON y.id = l.b WHERE x.file <> y.file),
locs AS (SELECT i, span, fa AS file, sa AS s, ea AS e FROM issue UNION SELECT i, span, fb, sb, eb FROM issue),
next AS (SELECT p.i AS a, q.i AS b FROM locs p JOIN locs q USING (file, s, e) WHERE p.i <> q.i AND greatest(p.span, q.span) // greatest(least(p.span, q.span), 1) <= 10),
comp(i, g) AS (SELECT i, i FROM issue UNION SELECT n.b, c.g FROM comp c JOIN next n ON n.a = c.i),
grp AS (SELECT i, min(g) AS g FROM comp GROUP BY i),
inst AS (SELECT DISTINCT g, file, s, e FROM locs JOIN grp USING (i))"""
CLONE_GROUPS = f"WITH RECURSIVE {ISSUE} SELECT first_value(file || '|' || s || '|' || e) OVER (PARTITION BY g ORDER BY file, s, e) AS group_key, file, s AS start_line, e AS end_line FROM inst"
DUP_STATS = f"""WITH RECURSIVE {ISSUE}, sz AS (SELECT g, count(*) AS n, min(e - s + 1) AS span FROM inst GROUP BY g HAVING count(*) >= 2),
u AS (SELECT count(*) AS n FROM (SELECT DISTINCT file, unnest(range(s, e + 1)) FROM inst SEMI JOIN sz USING (g))), t AS (SELECT sum(total_lines)::BIGINT AS t FROM ({LINE_METRICS}))
SELECT t AS total_lines, least((SELECT n FROM u), sum(span * n))::BIGINT AS duplicated_lines, round(least((SELECT n FROM u), sum(span * n)) / t * 100, 6) AS duplication_percentage, count(*) AS clone_groups, sum(n)::BIGINT AS clone_instances FROM sz, t GROUP BY t"""

WINDOW_SIZES = ", ".join(f"({s}, {4 if s > 10 else 2})" for s in WINDOWS)
FRAGMENTS = f"""{SRC}, txt AS (SELECT path, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM (SELECT path, string_split(regexp_replace(source, '\\r\\n', chr(10), 'g'), chr(10)) AS l FROM src)),
win AS (SELECT path, l, s, unnest(range(1, len(l) - s + 2, step)) AS a FROM txt, (VALUES {WINDOW_SIZES}) w(s, step) WHERE len(l) >= s),
cut AS (SELECT DISTINCT path, a AS start, a + s - 1 AS stop, array_to_string(l[a:a + s - 1], chr(10)) AS source FROM win),
frag AS (SELECT path || chr(9) || lpad(start::VARCHAR, 9, '0') || chr(9) || lpad(stop::VARCHAR, 9, '0') AS id, path, start, stop, list_filter(string_split({NORMAL.replace("{0}", "source")}, ' '), lambda x: x <> '') AS t FROM cut),
gram AS (SELECT id, list_transform(range(1, len(t) - 6), lambda i: (stop - start) || '|' || md5(array_to_string(t[i:i + 7], ' '))) AS g FROM frag WHERE len(t) >= 2 * (stop - start + 1) AND len(t) >= 8),
fps AS (SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(len(g) - 3, 1) + 1), lambda i: list_min(g[i:i + 3])))) AS f FROM gram),
key AS (SELECT id, md5(array_to_string(f, ',')) AS fp, f FROM fps), cls AS (SELECT fp, min(id) AS class, any_value(f) AS f FROM key GROUP BY fp), member AS (SELECT key.id, cls.class FROM key JOIN cls USING (fp)),
one AS (SELECT class, unnest(f) AS x, len(f) AS n FROM cls),
pair AS (SELECT p.class AS a, q.class AS b, count(*) / (any_value(p.n) + any_value(q.n) - count(*)) AS c FROM one p JOIN one q ON p.x = q.x AND p.class < q.class GROUP BY 1, 2),
close AS (SELECT a, b, c FROM pair WHERE c >= 0.85),
place AS (SELECT m.id, m.class, f.path AS file FROM member m JOIN frag f USING (id)),
ends AS (SELECT class, arg_min(file, (file, id)) AS lof, arg_min(id, (file, id)) AS loi, arg_max(file, (file, id)) AS hif, arg_max(id, (file, id)) AS hii FROM place GROUP BY class),
near AS (SELECT a AS class, b AS other, c FROM close UNION ALL SELECT b, a, c FROM close UNION ALL SELECT class, class, 1.0 FROM ends WHERE lof <> hif),
link AS (SELECT DISTINCT least(p.id, o) AS a, greatest(p.id, o) AS b, c FROM (SELECT p.id, CASE WHEN p.file <> e.lof THEN e.loi WHEN p.file <> e.hif THEN e.hii END AS o, n.c FROM near n JOIN place p ON p.class = n.class JOIN ends e ON e.class = n.other) p WHERE o IS NOT NULL),
match AS (SELECT CASE WHEN x.path < y.path THEN x.path ELSE y.path END AS path_a, CASE WHEN x.path < y.path THEN x.start ELSE y.start END AS start_a, CASE WHEN x.path < y.path THEN x.stop ELSE y.stop END AS end_a,
  CASE WHEN x.path < y.path THEN y.path ELSE x.path END AS path_b, CASE WHEN x.path < y.path THEN y.start ELSE x.start END AS start_b, CASE WHEN x.path < y.path THEN y.stop ELSE x.stop END AS end_b, round(l.c * 100) / 100 AS confidence
  FROM link l JOIN frag x ON x.id = l.a JOIN frag y ON y.id = l.b)"""

IMPORTERS = f"""{LATEST}, inst AS (SELECT e.target AS g, e.source AS file, 1 AS s, coalesce(l.loc, 0) % 40 + 5 AS e FROM edge e JOIN latest l ON l.path = e.source),
sz AS (SELECT g, min(e - s + 1) AS n FROM inst GROUP BY g HAVING count(*) >= 2)"""
FAMILIES = f"""WITH {IMPORTERS} SELECT a.file AS file_a, b.file AS file_b, count(*) AS group_count, sum(n)::BIGINT AS lines
FROM (SELECT DISTINCT g, file FROM inst) a JOIN (SELECT DISTINCT g, file FROM inst) b ON a.g = b.g AND a.file < b.file JOIN sz ON sz.g = a.g GROUP BY 1, 2 HAVING count(*) >= 2"""
MIRRORED = f"""WITH {IMPORTERS}, d AS (SELECT DISTINCT g, regexp_replace(file, '/[^/]*$', '') AS dir, split_part(file, '/', -1) AS name FROM inst),
p AS (SELECT a.g, a.dir AS x, b.dir AS y FROM (SELECT DISTINCT g, dir FROM d) a JOIN (SELECT DISTINCT g, dir FROM d) b ON a.g = b.g AND a.dir < b.dir),
names AS (SELECT x, y, name FROM p JOIN d ON d.g = p.g AND d.dir IN (x, y)),
l AS (SELECT x, y, sum(n)::BIGINT AS lines FROM p JOIN sz USING (g) GROUP BY 1, 2)
SELECT x AS dir_a, y AS dir_b, string_agg(DISTINCT name, ',' ORDER BY name) AS files, any_value(lines) AS lines FROM names JOIN l USING (x, y) GROUP BY 1, 2 HAVING count(DISTINCT name) >= 3"""

SPECS = rf"""{LINE}, spec AS (SELECT DISTINCT path, regexp_extract(text, '^(?:import|export)\b.*?\bfrom\s*["'']([^"'']+)["'']', 1) AS s FROM (SELECT path, language, ltrim(text, chr(65279)) AS text FROM line) WHERE language IN {SCRIPTS} AND regexp_matches(text, '^(import|export)\b.*\bfrom\s*["'']')
  UNION SELECT DISTINCT path, regexp_extract(text, '^import\s*["'']([^"'']+)["'']', 1) FROM line WHERE language IN {SCRIPTS} AND regexp_matches(text, '^import\s*["'']')
  UNION SELECT DISTINCT path, regexp_extract(text, '(?:^|[^A-Za-z0-9_$.])(?:import|require)\(["'']([^"'']+)["'']\)', 1) FROM line WHERE language IN {SCRIPTS} AND regexp_matches(text, '(^|[^A-Za-z0-9_$.])(import|require)\(["'']'))"""
PACKAGES = rf"""WITH {SPECS} SELECT DISTINCT path, CASE WHEN s LIKE '@%' THEN array_to_string(string_split(s, '/')[1:2], '/') ELSE split_part(s, '/', 1) END AS package FROM spec WHERE s <> '' AND NOT regexp_matches(s, '^(\.|/|@/|~|#)')"""
UNRESOLVED = rf"""WITH {SPECS}, near AS (SELECT path, s, array_to_string(string_split(path, '/')[:-2], '/') AS dir FROM spec WHERE regexp_matches(s, '^(\./|\.\./|@/|~/|#)')),
base AS (SELECT path, s, CASE WHEN s LIKE './%' THEN dir || substr(s, 2) WHEN s LIKE '../%' THEN regexp_replace(dir, '/?[^/]*$', '') || substr(s, 3) END AS b FROM near)
SELECT DISTINCT path AS source, s AS spec FROM base WHERE b IS NULL OR NOT EXISTS (SELECT 1 FROM files f WHERE f.path IN (b, b || '.ts', b || '.tsx', b || '.js', b || '.jsx', b || '.rs', b || '/index.ts', b || '/index.tsx', b || '/index.js', b || '/index.jsx', b || '/index.rs'))"""

NGRAMS = r"""
WITH f AS (SELECT path, any_value(source) AS source FROM files WHERE source IS NOT NULL GROUP BY path),
t AS (SELECT path, regexp_extract_all(source, '[\p{L}\p{N}_]+!?|"(?:[^"\\]|\\(?s:.))*"?|''(?:[^''\\]|\\(?s:.))*''?|===|!==|\.\.\.|->|=>|::|==|!=|&&|\|\||\?\?|<=|>=|\.\.|\S') AS t FROM f),
g AS (SELECT path, unnest(list_transform(range(1, len(t)), lambda i: t[i:i + 1]) || list_transform(range(1, len(t) - 1), lambda i: t[i:i + 2]) || list_transform(range(1, len(t) - 2), lambda i: t[i:i + 3])) AS g FROM t),
k AS (SELECT path, array_to_string(g, ' ') AS pattern FROM g WHERE len(list_filter(g, lambda x: NOT list_contains(string_split('{ } ( ) [ ] ; , . : :: => -> = == === != !== < > <= >= + - * / | || && & # @ ? ?? ! ... ..', ' '), x))) > 0),
s AS (SELECT pattern, count(DISTINCT path) AS file_count, count(*) AS occurrences FROM k GROUP BY 1 HAVING count(DISTINCT path) >= 3),
r AS (SELECT pattern, file_count, occurrences, round(least(greatest(log2((SELECT count(*) FROM f) / file_count) * (occurrences / file_count), 0), 10) / 10 * 100) / 100 AS info_score FROM s)
SELECT * FROM r ORDER BY info_score * file_count DESC, pattern LIMIT 30
"""
# the removal of patterns inside longer ones, decided in order: each step sees what the steps before it removed
REPEATED = NGRAMS.replace("WITH f AS", "WITH RECURSIVE f AS", 1).replace("SELECT * FROM r ORDER BY", ", top AS (SELECT row_number() OVER (ORDER BY info_score * file_count DESC, pattern) AS i, * FROM r ORDER BY", 1) + """),
step(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT s.i + 1, CASE WHEN EXISTS (SELECT 1 FROM top p, top q WHERE p.i = s.i + 1 AND q.i <> p.i AND NOT list_contains(s.gone, q.i)
  AND octet_length(encode(p.pattern)) < octet_length(encode(q.pattern)) AND contains(q.pattern, p.pattern) AND p.file_count / q.file_count >= 0.8) THEN list_append(s.gone, s.i + 1) ELSE s.gone END FROM step s WHERE s.i < (SELECT count(*) FROM top)),
kept AS (SELECT * FROM top WHERE NOT list_contains((SELECT arg_max(gone, i) FROM step), top.i))
SELECT pattern, file_count, occurrences, info_score, (SELECT array_to_string(list_sort(list(DISTINCT path))[1:5], ',') FROM k WHERE k.pattern = kept.pattern) AS example_files FROM kept
"""

NAMED = "CASE category WHEN 'unused_export' THEN 'unused_exports' WHEN 'unused_type' THEN 'unused_types' WHEN 'gotcha' THEN 'gotchas' WHEN 'circular_dependency' THEN 'circular_dependencies' ELSE category END"
UNIFIED = f"u AS (SELECT DISTINCT issue_id, {NAMED} AS category, file, line, impact, confidence, suggested_action, reason FROM ai_issues)"

SNAPSHOTS = """k AS (SELECT DISTINCT reported_at, category, file || ':' || coalesce(line::VARCHAR, '-') AS key FROM ai_issues WHERE file IS NOT NULL AND category IS NOT NULL),
b AS (SELECT DISTINCT category, key FROM k WHERE reported_at < TIMESTAMPTZ '2025-05-01 00:00:00+00'), a AS (SELECT DISTINCT category, key FROM k WHERE reported_at >= TIMESTAMPTZ '2025-05-01 00:00:00+00')"""
DIFF = f"""WITH {SNAPSHOTS} SELECT 'new' AS status, * FROM a ANTI JOIN b USING (category, key) UNION ALL SELECT 'fixed', * FROM b ANTI JOIN a USING (category, key) UNION ALL SELECT 'persisting', * FROM a SEMI JOIN b USING (category, key)"""

GUARD = """WITH f AS (SELECT path, arg_min(source, loaded_at) AS source, arg_min(sha256, loaded_at) AS sha FROM files WHERE source IS NOT NULL AND sha256 IS NOT NULL GROUP BY path)
SELECT path, CASE WHEN path LIKE '%/tests/%' THEN 'missing' WHEN sha256(source) = regexp_replace(lower(sha), '^sha256:', '') THEN 'ok' ELSE 'mismatch' END AS status FROM f"""

ALIASES = f"""WITH {LATEST}, s AS (SELECT DISTINCT source AS importer, regexp_replace(target, '\\.[a-z]+$', '') AS base FROM edge),
x AS (SELECT * FROM (VALUES ('ts', 1), ('tsx', 2), ('js', 3), ('jsx', 4), ('rs', 5)) v(ext, o)), f AS (SELECT DISTINCT path FROM files),
h AS (SELECT base, arg_min(f.path, o) AS target FROM (SELECT DISTINCT base FROM s) b, x, f WHERE f.path = b.base || '.' || x.ext GROUP BY base)
SELECT importer, CASE WHEN base LIKE 'orchard-monorepo/%' THEN '@orchard/' || substr(base, 18) ELSE base END AS spec, h.target FROM s LEFT JOIN h USING (base)"""


def match_sql(m) -> str:
    kind, what = m[0], quoted(m[1])
    name = "split_part(path, '/', -1)"
    if kind == "file":
        return f"(path = {what} OR ends_with(path, {quoted('/' + m[1])}))"
    if kind == "prefix":
        return f"starts_with(path, {what})"
    if kind == "file_has":
        return f"contains({name}, {what})"
    if kind == "path_has":
        return f"contains(path, {what})"
    if kind == "prefix_file":
        return f"(starts_with(path, {what}) AND {name} IN {word_list(m[2])})"
    return f"(list_contains(string_split(path, '/'), {what}) AND split_part({name}, '.', 1) IN {word_list(m[2])})"


_parts = " OR ".join(f"contains(lower(path), {quoted(x)})" for x in TEST_FIXTURE_PARTS) + " OR " + " OR ".join(f"ends_with(lower(path), {quoted(x)})" for x in TEST_FIXTURE_ENDS)
_langs = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in LANGUAGES.items())
PREDICATES = f"""SELECT DISTINCT path, {TEST_FILE} AS test, ({_parts}) AS fixture, {SCRIPT_FILE} AS script, list_has_any(string_split(path, '/')[:-2], [{', '.join(map(quoted, SKIPPED_DIRS))}]) OR len(string_split(path, '/')) > 20 AS skipped,
CASE WHEN ends_with(path, '.d.ts') THEN NULL ELSE CASE split_part(path, '.', -1) {_langs} END END AS language, len(string_split(path, '/')) - 2 >= 0 AS inside, contains(path, '*/src/') AS globbed FROM files"""

SCALARS = rf"""SELECT DISTINCT doc_id, sha256({NORMAL_TEXT}) AS normal, sha256(text) AS sha, len(list_filter(string_split({NORMAL_TEXT}, ' '), lambda x: x <> ''))::INT AS words,
CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') WHEN path IS NULL THEN '.' ELSE '.' END AS dir, split_part(path, '/', -1) AS file, octet_length(encode(text))::INT AS octets,
len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+!?|"(?:[^"\\]|\\(?s:.))*"?|''(?:[^''\\]|\\(?s:.))*''?|===|!==|\.\.\.|->|=>|::|==|!=|&&|\|\||\?\?|<=|>=|\.\.|\S'))::INT AS tokens,
sha256(regexp_replace(regexp_replace(text, '([|`*_<>\[\]])', '\\\1', 'g'), '[\r\n]+', ' ', 'g')) AS escaped FROM documents WHERE text IS NOT NULL"""

EXPORTED = rf"""WITH {LINE}, x AS (SELECT path, ltrim(text, chr(65279)) AS text FROM line WHERE language IN {SCRIPTS} AND starts_with(ltrim(text, chr(65279)), 'export ')),
d AS (SELECT path, regexp_extract(text, '^export (?:default )?(?:async )?(?:function\*?|class|interface|type|const|let|var) ([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS name, text FROM x)
SELECT DISTINCT path, CASE WHEN name <> '' AND NOT name IN ('enum', 'extends') THEN name ELSE 'default' END AS name FROM d WHERE name <> '' OR starts_with(text, 'export default')
UNION SELECT path, trim(name) FROM (SELECT path, unnest(string_split(regexp_extract(text, '^export \{{ ([^}}]*) \}}', 1), ',')) AS name FROM x) WHERE trim(name) <> ''
UNION SELECT path, unnest(regexp_extract_all(regexp_replace(text, '//.*$', ''), '\bpub(?:\([a-z]+\))? (?:async |unsafe |default )*(?:const fn|fn|struct|enum|trait|type|const|static mut|static|mod) ([A-Za-z_][A-Za-z0-9_]*)', 1)) FROM line WHERE language = 'rust'"""
UNUSED_TYPES = rf"""WITH {LINE}, x AS (SELECT DISTINCT path, regexp_extract(text, '^export (interface|type) ([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS kind, regexp_extract(text, '^export (interface|type) ([A-Za-z_$][A-Za-z0-9_$]*)', 2) AS name
  FROM line WHERE language IN {SCRIPTS} AND regexp_matches(text, '^export (interface|type) [A-Za-z_$]')),
i AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_extract(text, '^\s*import\s+(?:type\s+)?(.*?)\s+from\s', 1), '[A-Za-z_$][A-Za-z0-9_$]*')) AS name FROM line WHERE regexp_matches(text, '^\s*import\s'))
SELECT path, name, kind FROM x WHERE name NOT IN (SELECT name FROM i WHERE name NOT IN ('as', 'type'))"""

UNUSED_EXPORTS = """WITH p AS (SELECT DISTINCT 'src/part' || l_partkey || '.ts' AS path, l_suppkey::VARCHAR AS name FROM lineitem), r AS (SELECT DISTINCT 'src/part' || l_partkey || '.ts' AS path, l_suppkey::VARCHAR AS name FROM lineitem WHERE l_returnflag = 'R')
SELECT path, name FROM p ANTI JOIN r USING (path, name)"""

ORACLE = {
    "p1_found": P1_FOUND, "dead_nodes": DEAD_NODES, "seeded_dead": SEEDED_DEAD, "cycles": CYCLES, "import_components": COMPONENTS, "python_neighbours": NEIGHBOURS, "exported_names": EXPORTED, "unused_types": UNUSED_TYPES, "unused_exports": UNUSED_EXPORTS,
    "duplicate_exports": f"WITH e AS ({EXPORTED}) SELECT name, string_agg(path, ',' ORDER BY path) AS locations FROM e WHERE name NOT IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH', 'HEAD', 'OPTIONS', 'metadata', 'generateMetadata', 'dynamic', 'revalidate', 'dynamicParams', 'default', 'up', 'down', 'config') GROUP BY name HAVING count(*) > 1",
    "unused_deps": UNUSED_DEPS + "SELECT DISTINCT package, 'dependencies' AS section FROM m WHERE package NOT IN (SELECT package FROM p WHERE path LIKE '%/src/%')",
    "unlisted_deps": UNUSED_DEPS + "SELECT DISTINCT path, package FROM p WHERE package <> '' AND package NOT IN (SELECT package FROM m WHERE path LIKE '%/tests/%')",
    "line_metrics": LINE_METRICS, "lookahead_rule": LOOKAHEAD,
    "blocks_found": "SELECT DISTINCT b.path, b.start_line, b.end_line FROM blocks b SEMI JOIN files f ON f.path = b.path AND f.source IS NOT NULL",
    "block_clones": BLOCK_CLONES, "block_clone_members": BLOCK_MEMBERS, "clone_groups": CLONE_GROUPS, "dup_stats": DUP_STATS, "fragment_clones": f"WITH {FRAGMENTS} SELECT * FROM match", "clone_families": FAMILIES, "mirrored_dirs": MIRRORED, "external_packages": PACKAGES, "unresolved_imports": UNRESOLVED, "ngram_patterns": NGRAMS, "repetitive_patterns": REPEATED,
    "top_issues": f"WITH {UNIFIED} SELECT issue_id, category, file, impact FROM u WHERE impact IS NOT NULL AND NOT isnan(impact) ORDER BY impact DESC, issue_id LIMIT 20",
    "files_at_risk": f"WITH {UNIFIED} SELECT file, {', '.join(f'''count(*) FILTER (WHERE category = '{c}') AS {c}''' for c in AT_RISK)} FROM u WHERE file IS NOT NULL GROUP BY file ORDER BY count(*) FILTER (WHERE category IN ('dead_code', 'unused_exports', 'unused_types', 'gotchas')) DESC, file LIMIT 10",
    "issues_per_file": f"WITH {UNIFIED} SELECT file, count(*) AS issues FROM u WHERE file IS NOT NULL GROUP BY file",
    "top_risk_file": f"WITH {UNIFIED} SELECT file AS path, count(*) AS unused FROM u WHERE file IS NOT NULL AND category = 'unused_exports' GROUP BY file ORDER BY 2 DESC, 1 LIMIT 1",
    "category_leaders": f"WITH {UNIFIED}, r AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY impact DESC, issue_id)::INT AS rank, issue_id FROM u WHERE impact IS NOT NULL AND NOT isnan(impact)) SELECT * FROM r WHERE rank <= 5",
    "first_finding": f"WITH {UNIFIED} SELECT file, line, issue_id FROM u WHERE category = 'gotchas' AND file IS NOT NULL AND line IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file ORDER BY line, issue_id) = 1",
    "confident_issues": f"WITH {UNIFIED} SELECT category, count(*) AS issues FROM u WHERE confidence IS NULL OR confidence >= 0.8 GROUP BY category",
    "health_score": f"WITH {UNIFIED}, c AS (SELECT (SELECT count(DISTINCT path) FROM files) AS total_files, (SELECT count(*) FROM u WHERE category IN {word_list(SCORED)} AND confidence >= 0.95) AS total_issues, 12.5::DOUBLE AS duplication_percentage) SELECT *, round(least(greatest(100.0::DOUBLE - total_issues / total_files * 10 - duplication_percentage * 0.3, 0), 100) * 10) / 10 AS health_score FROM c",
    "snapshot_diff": DIFF, "diff_net": f"SELECT category, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'fixed') AS fixed, count(*) FILTER (WHERE status = 'new') - count(*) FILTER (WHERE status = 'fixed') AS net FROM ({DIFF}) WHERE status <> 'persisting' GROUP BY category",
    "baseline_apply": f"WITH {SNAPSHOTS} SELECT category || '::' || key AS fingerprint FROM a ANTI JOIN b USING (category, key)",
    "guard_check": GUARD, "guard_counts": f"SELECT count(*) FILTER (WHERE status = 'ok') AS passed, count(*) FILTER (WHERE status <> 'ok') AS failed FROM ({GUARD})",
    "alias_resolution": ALIASES, "path_predicates": PREDICATES, "scalar_functions": SCALARS,
    "watched_languages": "SELECT language, count(*) AS files FROM (SELECT path, arg_max(language, loaded_at) AS language, arg_max(source, loaded_at) AS source FROM files GROUP BY path) WHERE source IS NOT NULL AND NOT list_has_any(string_split(path, '/')[:-2], [" + ', '.join(map(quoted, SKIPPED_DIRS)) + "]) GROUP BY language",
}
