"""DuckDB SQL for the queries of sample_queries: computed from the same rows where SQL can, and the rows expected of the sample where it takes a parser."""

from __future__ import annotations

from codeloom.operators.entries import DEFAULT_ENTRIES, PROFILES, TOOLING_PREFIXES
from codeloom.operators.lint import FILE_RULES, LINE_RULES
from codeloom.plans import samples
from codeloom.plans.core_oracle import COMMENT, LINE, SCRIPTS, SRC, TEST_FILE, match_sql, quoted, rule_sql, word_list
from codeloom.plans.sample_rows import EXPECTED

TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(x) -> str:
    return quoted(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def values(schema: str, rows) -> str:
    """A query that gives the rows."""
    cols = [c.split() for c in schema.split(", ")]
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    named = [(f'"{c}"', TYPES[t]) for c, t in cols]
    return f"SELECT {', '.join(f'{c}::{t} AS {c}' for c, t in named)} FROM (VALUES {body}) v({', '.join(c for c, _ in named)})"


FILES = "(" + values("path string, language string, source string", samples.FILES) + ")"
BOTH = f"src AS (SELECT DISTINCT path, language, source FROM files WHERE source IS NOT NULL UNION ALL SELECT path, language, source FROM {FILES})"
LINES = LINE.replace(SRC, BOTH)
JS = r"regexp_matches(path, '\.(ts|tsx|js|jsx)$')"


def _file_rule(r) -> str:
    has = [f"contains(source, {quoted(n)})" for n in r.needles]
    cond = (" AND " if r.kind == "all" else " OR ").join(has)
    out = "".join(f" AND NOT contains(source, {quoted(x)}) AND NOT contains(path, {quoted(x)})" for x in r.exclusions)
    return f"SELECT path, {quoted(r.rule)} AS rule, {quoted(r.severity)} AS severity, {r.confidence}::DOUBLE AS confidence, {quoted(r.needles[0])} AS needle FROM src WHERE NOT {TEST_FILE} AND ({cond}){out}"


FILE_RULES_SQL = f"WITH {LINES}, f AS ({' UNION ALL '.join(map(_file_rule, FILE_RULES))}) SELECT f.path AS file, min(l.line)::BIGINT AS line, rule, severity, confidence FROM f JOIN line l ON l.path = f.path AND contains(l.text, f.needle) GROUP BY ALL"
HELL = f"""WITH {LINES}, j AS (SELECT path, line, text FROM line WHERE {JS} AND NOT {TEST_FILE}), a AS (SELECT path, list(text ORDER BY line) AS l FROM j GROUP BY path),
c AS (SELECT path, line FROM j WHERE NOT {COMMENT} AND (contains(text, 'function(') OR contains(text, 'function (') OR contains(text, '=>'))),
d AS (SELECT path, line, list_reduce(list_prepend(0, list_transform(regexp_extract_all(array_to_string(l[1:line - 1], ''), '[{{}}]'), lambda m: CASE WHEN m = '{{' THEN 1 ELSE -1 END)), lambda x, y: greatest(x + y, 0)) AS depth FROM c JOIN a USING (path))
SELECT path AS file, min(line)::BIGINT AS line FROM d WHERE depth >= 4 GROUP BY path"""
PROMISES = f"""WITH {LINES}, j AS (SELECT path, line, text, max(contains(text, '.catch(')::INT) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS caught FROM line WHERE {JS} AND NOT {TEST_FILE})
SELECT path AS file, line::BIGINT AS line FROM j WHERE contains(text, '.then(') AND caught = 0 AND NOT {COMMENT}"""
BARRELS = rf"""WITH {BOTH}, flat AS (SELECT path, string_split(regexp_replace(regexp_replace(source, '\r\n', chr(10), 'g'), 'export\s+(type\s+)?\{{[^}}]*\}}(\s*from\s+[''"][^''"]*[''"])?\s*;?', 'export {{}}\2;', 'g'), chr(10)) AS l FROM src),
s AS (SELECT path, list_filter(list_transform(l, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: NOT regexp_matches(x, '^(//|/\*|\*|$)')) AS l FROM flat),
n AS (SELECT path, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(x, '^export \*|^export\b.*\sfrom\s'))) AS k, regexp_matches(path, '(^|/)index\.(ts|tsx|js|jsx)$') AS index FROM s)
SELECT DISTINCT path FROM n WHERE n > 0 AND ((k >= 1 AND k = n) OR (index AND k / n > 0.6) OR (NOT index AND k / n > 0.3 AND k >= 3))"""
COUNTS = rf"SELECT DISTINCT path, functions, classes FROM files WHERE source IS NOT NULL AND classes IS NOT NULL AND functions IS NOT NULL AND language IN {SCRIPTS} AND NOT regexp_matches(source, '(?m)^(use [a-z_]+::|from \S+ import |import [a-z_]+\r?$|def |(pub )?fn )')"

PATHS = f"(SELECT DISTINCT regexp_replace(path, '^[^/]+/', '') AS path FROM files UNION {values('path string', [(p,) for p in samples.PROFILE_PATHS])})"


def _profile(name: str) -> str:
    any_of = lambda ms: " OR ".join(map(match_sql, ms)) or "false"
    p = PROFILES[name]
    return f"""SELECT {quoted(name)} AS profile, path, 'framework' AS class FROM p WHERE {any_of(p['entry'])} OR path IN {word_list(DEFAULT_ENTRIES)} OR regexp_matches(path, '(^|/)src/bin/.*\\.rs$')
UNION ALL SELECT {quoted(name)}, path, 'implicit' FROM p WHERE {any_of(p['implicit'])} OR {' OR '.join(f'starts_with(lower(path), {quoted(t)})' for t in TOOLING_PREFIXES)} OR regexp_matches(path, '(^|/)(build\\.rs$|tests/.*\\.rs$|benches/.*\\.rs$|examples/.*\\.rs$|fuzz/.*\\.rs$)')"""


ENTRY_CLASSES = f"WITH p AS {PATHS} " + " UNION ALL ".join(map(_profile, PROFILES))
EXAMPLES = f"WITH p AS (SELECT path FROM files UNION {values('path string', [(p,) for p in samples.PROFILE_PATHS])}) SELECT path, regexp_matches(lower(path), '(^|/)(integration|sample|samples|example|examples|demo|demos)/') AS example, regexp_matches(path, '(^|/)lib\\.rs$') AS crate_root FROM p"
EXCLUDED = r"SELECT DISTINCT path FROM files WHERE NOT contains(path, 'orchard-monorepo/') AND NOT regexp_matches(path, '^[^/]*/src/[^/]*/[^/]*\.ts$') AND NOT ends_with(path, '.py') AND NOT contains(path, '*/tests/')"
SAVED = """SELECT DISTINCT 'baseline' AS kind, category || '::' || file AS key, '' AS value FROM ai_issues WHERE file IS NOT NULL AND category IS NOT NULL
UNION ALL SELECT 'guard', path, min('sha256:' || sha256(source)) FROM files WHERE source IS NOT NULL GROUP BY path
UNION ALL SELECT DISTINCT 'analysis', file, line::VARCHAR FROM ai_issues WHERE file IS NOT NULL AND line IS NOT NULL"""
GUARD = """WITH f AS (SELECT path, min(source) AS source FROM files WHERE source IS NOT NULL GROUP BY path)
SELECT path, CASE WHEN path LIKE '%.rs' OR path LIKE '%.py' THEN 'sha256:' || sha256(source) ELSE 'sha256:old' END AS hash, CASE WHEN path LIKE '%.rs' THEN 'rust' ELSE 'kept' END AS description FROM f WHERE (path LIKE '%/src/%' OR path LIKE '%.rs') AND path NOT LIKE '%/core/%'"""


def _cut(text: str, most: int, keep: int) -> str:
    fit = f"len(list_filter(range(1, {keep + 1}), lambda i: octet_length(encode(substr({text}, 1, i))) <= {keep}))"
    return f"CASE WHEN octet_length(encode({text})) > {most} THEN substr({text}, 1, {fit}) || '...' ELSE {text} END"


TRIMMED = r"regexp_replace(regexp_replace(text, '^[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', ''), '[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+$', '')"
CELL = "regexp_replace(replace(replace(replace(replace(replace(replace(text, '|', '\\|'), '[', '\\['), ']', '\\]'), '`', '\\`'), '<', '&lt;'), '>', '&gt;'), '[\\r\\n]', ' ', 'g')"
HELPERS = rf"""WITH d AS (SELECT DISTINCT doc_id, text, {TRIMMED} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256({_cut('t', 120, 117)}) AS line, sha256({_cut('text', 200, 200)}) AS snippet, sha256(regexp_replace(replace(text, '"', '#quot;'), '[\r\n]+', ' ', 'g')) AS label, sha256(regexp_replace(text, '[^A-Za-z0-9_]', '_', 'g')) AS ident,
sha256('''' || replace(text, '''', '''\''''') || '''') AS quoted, sha256(text) AS plain, sha256(text) AS bare, sha256({CELL}) AS cell, doc_id::VARCHAR AS rest FROM d"""
FOLDERS = """WITH g AS (SELECT repo, language, string_split(min(path), '/') AS lo, string_split(max(path), '/') AS hi FROM files WHERE repo IS NOT NULL AND language IS NOT NULL GROUP BY repo, language),
k AS (SELECT repo, language, lo, len(list_filter(range(1, least(len(lo), len(hi))), lambda i: lo[1:i] = hi[1:i])) AS n FROM g) SELECT repo, language, CASE WHEN n = 0 THEN '' ELSE array_to_string(lo[1:n], '/') || '/' END AS folder FROM k"""
CACHED = f"SELECT path, sha256(CASE WHEN path = 'src/ring/a.ts' THEN 'export const q = 1;' || chr(10) ELSE source END) AS sha FROM {FILES} WHERE path NOT LIKE 'crate/%'"

ORACLE = {name: values(schema, rows) for name, (schema, rows) in EXPECTED.items()} | {
    "line_rules": f"WITH {LINES} " + " UNION ALL ".join(rule_sql(r) for r in LINE_RULES), "file_rules": FILE_RULES_SQL, "callback_hell": HELL, "unhandled_promises": PROMISES, "barrels": BARRELS, "function_counts": COUNTS, "entry_classes": ENTRY_CLASSES, "example_paths": EXAMPLES,
    "excluded_paths": EXCLUDED, "saved_states": SAVED, "guard_updates": GUARD, "text_helpers": HELPERS, "common_folders": FOLDERS, "cache_runs_of_facts": CACHED,
}
