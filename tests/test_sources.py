import hashlib
import json
import random

import pandas as pd
import zstandard
from pyspark.sql import functions as F

from codeloom.functions import fingerprints
from codeloom.functions.rust_facts import rust_facts, use_tree
from codeloom.functions.script_facts import script_facts
from codeloom.operators import clones, entries, facts, lint, patterns, summary
from codeloom.plans import core_queries, fix, reports
from codeloom.plans.analyze import analyze
from codeloom.registry import Plugin, Registry
from codeloom.session import swap_text
from codeloom.sources import manifests, scan, snapshots, workspaces
from codeloom.streaming.watch import Watcher

SRC = "path string, language string, source string"


def test_scan(spark, tmp_path, rows):
    for p, text in {"src/a.ts": "export const a = 1\n", "src/b.d.ts": "x", "node_modules/m/i.js": "x", "lib/c.py": "x = 1\n", "README.md": "x", "package.json": "{}", "vendor/v.rs": "x"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    (tmp_path / "src/bin.js").write_bytes(b"\xff\xfe\x00")
    tree = scan.read_tree(spark, str(tmp_path))
    assert rows(scan.discover_source_files(tree)) == [("lib/c.py", "python"), ("src/a.ts", "typescript"), ("src/bin.js", "javascript")]
    assert rows(scan.read_sources(tree).select("path", "source")) == [("lib/c.py", "x = 1\n"), ("src/a.ts", "export const a = 1\n")]
    assert rows(scan.discover_config_files(tree)) == [("package.json",)]


def test_globs(spark, rows):
    files = spark.createDataFrame([(p,) for p in ("src/a.test.ts", "src/x/a.test.ts", "vendor/q.ts", "a/vendor/q.ts", "b.ts")], "path string")
    left = lambda *g: [r[0] for r in rows(scan.filter_excluded(files, list(g)))]
    assert left("src/*.test.ts") == ["a/vendor/q.ts", "b.ts", "src/x/a.test.ts", "vendor/q.ts"]
    assert left("vendor/**", "**/*.test.ts") == ["b.ts", "src/a.test.ts", "src/x/a.test.ts"]
    assert left() == sorted(r[0] for r in files.collect())


def test_manifests(spark, rows):
    text = '{\n  // note\n  "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "bad": ["../x"], "abs": ["/x"], "s": ["a//b",]}}, /* "x" */\n}'
    assert manifests.tsconfig_aliases("tsconfig.json", text) == [(None, 0, "@/", "src/"), (None, 1, "s", "a/b")]
    assert manifests.tsconfig_aliases("pkg/tsconfig.app.json", text)[0] == ("pkg", 0, "@/", "pkg/src/")
    assert manifests.tsconfig_aliases("t.json", "{oops") == []
    package = json.dumps({"name": "@s/ui", "exports": {".": "./src/index.ts", "./button": {"import": "./src/button.ts"}, "./x/*": {"default": "./src/x/*"}}, "dependencies": {"a": "1"}, "optionalDependencies": {"b": "1"}})
    assert manifests.workspace_aliases("packages/ui/package.json", package) == [("@s/ui", "packages/ui/src/index.ts"), ("@s/ui/button", "packages/ui/src/button.ts"), ("@s/ui/x/", "packages/ui/src/x/"), ("@s/ui/", "packages/ui/"), ("@s/ui", "packages/ui")]
    assert manifests.is_published("packages/ui/package.json", package) and not manifests.is_published("apps/x/package.json", package)
    assert manifests.workspace_globs("packages:\n  - 'apps/*'\n  - \"libs/*\"\nother: 1\n") == ["apps/", "libs/"] and manifests.workspace_globs("packages: ['a/*', b/*]\n") == ["a/", "b/"]
    assert manifests.cargo_targets("c/Cargo.toml", '[lib]\npath = "src/l.rs"\n[[bin]]\nname = "b"\n[[test]]\nname="t"\npath = "tests/t.rs"\n') == [("c/src/l.rs", "framework"), ("c/src/bin/b.rs", "framework"), ("c/tests/t.rs", "implicit")]
    assert rows(manifests.declared_crates(spark.createDataFrame([("c/Cargo.toml", '[lib]\npath = "l.rs"'), ("bad/Cargo.toml", "["), ("Cargo.toml", None)], "path string, source string"))) == [("c/l.rs", "framework")]
    assert manifests.strip_jsonc('{"a": "x,]y // no", /* c */ "b": [1, 2, // d\n ], }').replace(" ", "").replace("\n", "") == '{"a":"x,]y//no","b":[1,2]}'
    df = spark.createDataFrame([("package.json", package), ("bad/package.json", "{")], "path string, source string")
    assert rows(manifests.package_deps(df)) == [("package.json", "dependencies", "a"), ("package.json", "optionalDependencies", "b")]
    assert manifests.aliases(spark.createDataFrame([("tsconfig.json", text), ("packages/ui/package.json", package)], "path string, source string")).count() == 7


def test_snapshots(spark, tmp_path, rows):
    import pytest

    base = spark.createDataFrame([("b",), ("a",), ("a",)], "fingerprint string")
    path = f"file://{tmp_path}/baseline.json"
    snapshots.save_baseline(base, path, "2025-01-01")
    assert rows(snapshots.load_baseline(spark, path)) == [("a",), ("b",)]
    guard = spark.createDataFrame([("x", "sha256:1", None), ("y", "sha256:2", "d")], "path string, hash string, description string")
    snapshots.save_guard(guard, f"file://{tmp_path}/g.json")
    assert rows(snapshots.load_guard(spark, f"file://{tmp_path}/g.json")) == rows(guard)
    swap_text(spark, f"file://{tmp_path}/old.json", '{"version": 2}')
    with pytest.raises(ValueError):
        snapshots.load_baseline(spark, f"file://{tmp_path}/old.json")


SCRIPT = """import def, { a as b, type T } from './x';
import * as ns from "@s/n/deep";
import './side';
export * from './all';
export { c as d, Big } from './y';
export type { Q } from './z';
const lazy = import('./lazy'); const r = require('pkg/sub'); new Worker(new URL('./w', import.meta.url));
export const one = 1, two = (x) => {
  if (x) {
    for (const y of x) { y && z(); }
  } else { q(); }
  return x ? 1 : 2;
};
export default class Main extends Base {
  run() {
    try { go(); } catch (e) {}
    return () => 1;
  }
}
export async function* gen() {}
export interface Shape { a: string }
export type Alias = string;
"""


def test_script_facts():
    f = script_facts(SCRIPT, "typescript")
    assert f.imports == ["./all", "./lazy", "./side", "./w", "./x", "./y", "./z", "@s/n/deep", "pkg/sub"]
    assert f.named_imports == [("./x", "def"), ("./x", "a"), ("@s/n/deep", "ns"), ("./y", "c"), ("./y", "Big"), ("./z", "Q")]
    assert f.exports == ["d", "Big", "Q", "one", "two", "Main", "gen", "Shape", "Alias"]
    assert f.type_exports == [("Big", "reexport"), ("Q", "type"), ("Shape", "interface"), ("Alias", "type")]
    assert f.reexports == [("./all", "*"), ("./y", "d"), ("./y", "Big"), ("./z", "Q")]
    assert [(b[0], b[1], b[2], b[3]) for b in f.blocks] == [("two", "arrow_function", 8, 13), ("Main", "class", 14, 19), ("run", "method", 15, 18)]
    assert (f.functions, f.classes, f.complexity, f.max_nesting_depth, f.empty_catches) == (3, 1, 7, 2, [16])


def test_rust_facts():
    exports, imports, mods, n = rust_facts("pub mod a; mod b;\nuse crate::x::{self, Y as Z, q::*};\npub(crate) async fn f() {}\nimpl S { pub const fn g() {} }\n/* pub fn no() {} */ pub static mut C: u8 = 1;\n")
    assert exports == ["a", "f", "g", "C"] and mods == ["a", "b"] and n == 2
    assert imports == [("crate", "x"), ("crate::x", "Y"), ("crate::x::q", "*")]
    assert use_tree(["a"]) == [("a", "a")]


def test_fact_cache_parses_only_changes(spark, tmp_path, rows):
    cache = facts.FactCache(spark, f"file://{tmp_path}/cache")
    one = [("a.ts", "typescript", "export const a = 1\n"), ("b.py", "python", "x\n"), ("n.ts", "typescript", None), ("l", None, "")]
    first = cache.refresh(spark.createDataFrame(one, SRC))
    assert rows(first.select("path", F.array_join("exports", ","))) == [("a.ts", "a"), ("b.py", ""), ("l", "")]
    second = cache.refresh(spark.createDataFrame([("a.ts", "typescript", "export const z = 1\n")], SRC))
    assert rows(second.select("path", F.array_join("exports", ","))) == [("a.ts", "z")]
    swap_text(spark, f"file://{tmp_path}/cache/CURRENT", "garbage")
    assert cache.load().count() == 0


LINT = [
    ("src/a.ts", "typescript", "if (x == null) {}\nif (x === 1) {}\n// TODO: later\neval('x')\nconst a: any = b as any;\nprocess.env.HOME\nprocess.env.HOME ?? 'x'\n * console.log(1)\nconsole.log(1)\n"),
    ("src/m.rs", "rust", "x.unwrap();\nlet s = \"panic!(\";\npanic!(\"x\");\nr.unwrap_or_else(|e| panic!(\"{e}\"));\nmytodo!(); todo!();\n"),
    ("tests/t.ts", "typescript", "eval('x')\n"), ("src/n.ts", "typescript", None), ("src/e.ts", "typescript", ""),
    ("src/p.ts", "typescript", "a.then(b)\n\n\n.catch(c)\nd.then(e)\nf\ng\nh\n.catch(i)\n" + "{ {\n{ {\nx => y\n"), ("app/c.tsx", "tsx", "'use client'\nexport const metadata = {}\n"),
]


def test_lint(spark, rows):
    df = spark.createDataFrame(LINT, SRC)
    got = rows(lint.line_issues(df).select("file", "line", "rule"))
    assert got == sorted([("src/a.ts", 1, "loose-equality"), ("src/a.ts", 3, "unresolved-comment"), ("src/a.ts", 4, "eval-usage"), ("src/a.ts", 5, "any-type"), ("src/a.ts", 5, "as-any-cast"), ("src/a.ts", 6, "env-no-fallback"), ("src/a.ts", 9, "console-statement"), ("src/m.rs", 1, "rust-unwrap"), ("src/m.rs", 3, "rust-panic"), ("src/m.rs", 5, "rust-todo")], key=str)
    assert rows(lint.unhandled_promises(df).select("file", "line")) == [("src/p.ts", 5)]
    assert rows(lint.callback_hell(df).select("file", "line")) == [("src/p.ts", 12)]
    assert rows(lint.file_issues(df).select("file", "line", "rule")) == [("app/c.tsx", 1, "nextjs-metadata-in-client")]
    assert [r.severity for r in lint.ordered(lint.line_issues(df)).collect()][0] == "critical"
    assert lint.line_issues(df.limit(0)).count() == 0


def test_clones_and_what_follows(spark, rows):
    code = "function processUser(user: User) {\n  const name = user.name;\n  const email = user.email;\n  const age = user.age;\n  console.log(name, email, age);\n  return { name, email, age };\n}"
    blocks = spark.createDataFrame([(i, f"d{i % 2}/f{i}.ts", "p", 1 + 10 * i, 7 + 10 * i, code) for i in range(3)] + [(9, "x.ts", "short", 1, 3, "a\nb\nc"), (10, "x.ts", None, 1, 9, None)], "block_id bigint, path string, name string, start_line bigint, end_line bigint, source string")
    members, pairs = clones.block_clones(blocks)
    assert pairs.count() == 0 and {r.id for r in members.collect()} == {0, 1, 2}
    issues = clones.located_issues(members, pairs, blocks.select(F.col("block_id").alias("id"), F.col("path").alias("file"), "name", "start_line", "end_line"))
    assert issues.count() == 2 and {r.confidence for r in issues.collect()} == {1.0}
    groups = clones.clone_groups(issues)
    assert groups.count() == 3 and groups.select("group_id").distinct().count() == 1
    assert clones.group_sizes(groups).first()["token_count"] == 42
    total = spark.createDataFrame([(200,)], "total_lines bigint")
    assert tuple(clones.duplication_stats(groups, total).first()) == (200, 21, 10.5, 1, 3)
    inst = "group_id bigint, file string, start_line bigint, end_line bigint"
    two = spark.createDataFrame([(1, "a", 1, 10), (1, "b", 1, 10), (2, "a", 20, 30), (2, "b", 40, 50)], inst)
    assert rows(clones.clone_families(two)) == [("a", "b", 2, 21)]
    mirrored = spark.createDataFrame([(i, f"{d}/{n}.ts", 1, 5) for i, n in enumerate("abc") for d in ("src", "lib")], inst)
    assert [(r.dir_a, r.dir_b, r.files, r.lines) for r in clones.mirrored_directories(mirrored).collect()] == [("lib", "src", ["a.ts", "b.ts", "c.ts"], 15)]
    overlap = spark.createDataFrame([(1, "a.ts", 1, 10), (1, "a.ts", 5, 15)], inst)
    assert clones.duplication_stats(overlap, total).first()["duplicated_lines"] == 15
    assert clones.merge_matches([(1, 5, 1, 5, 0.9), (4, 8, 40, 44, 1.0), (20, 24, 80, 84, 0.8)]) == [[1, 8, 1, 44, 1.0], [20, 24, 80, 84, 0.8]]
    line = "  const value = computeSomething(data, opts);\n"
    frags = clones.merged_fragments(clones.fragment_matches(spark.createDataFrame([("a.ts", "typescript", line * 12), ("b.ts", "typescript", line * 12)], SRC)))
    assert all(r.end_a - r.start_a > 4 for r in frags.collect()) and frags.count() >= 1
    assert len(clones.kgram_hashes(["a", "b", "c", "d", "e"], 3)) == 3 and clones.winnow64(["a"] * 7) == [] and all(0 <= h < 2**64 for h in clones.winnow64(list("abcdefghijklmnop")))


def test_similar_classes_link_every_member(spark, rows):
    places = spark.createDataFrame([(1, "F"), (5, "G"), (2, "F"), (7, "H"), (8, "H"), (9, "K")], "id int, file string").selectExpr("id", "file", "'n' AS name", "id AS start_line", "id + 5 AS end_line")
    members = spark.createDataFrame([(1, 1), (5, 1), (2, 2), (7, 7), (8, 7), (9, 9)], "id int, class int")
    pairs = spark.createDataFrame([(1, 2, 0.8), (7, 9, 0.9)], "a int, b int, similarity double")
    got = rows(clones.located_issues(members, pairs, places).select("start_a", "start_b", "confidence"))
    assert got == [(1, 5, 1.0), (2, 5, 0.8), (7, 9, 0.9), (8, 9, 0.9)]


def test_fragment_query_runs_every_window(spark, tmp_path):
    rng = random.Random(3)
    line = lambda: "  const " + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(5)) + "\n"
    shared, long = [line() for _ in range(5)], [line() for _ in range(30)]
    texts = {"a.ts": [line() for _ in range(4)] + shared + [line() for _ in range(9)] + long, "b.ts": [line() for _ in range(10)] + shared + [line() for _ in range(9)], "c.ts": long[:17] + ["  const other\n"] + long[18:]}
    stamped = spark.createDataFrame([(p, "typescript", "".join(t)) for p, t in texts.items()], SRC)
    stamped.write.parquet(f"{tmp_path}/files.parquet")
    got = {side for r in core_queries.fragment_clones(spark, str(tmp_path)).collect() for side in ((r.path_a, r.start_a, r.end_a), (r.path_b, r.start_b, r.end_b))}
    windows = [(r.path, r.start_line, r.end_line, set(r.fps)) for r in clones.fragments(stamped).collect()]
    alike = lambda x, y: x[0] != y[0] and x[2] - x[1] == y[2] - y[1] and len(x[3] & y[3]) >= 0.85 * len(x[3] | y[3])
    assert got == {x[:3] for x in windows if any(alike(x, y) for y in windows)}
    assert ("a.ts", 5, 9) in got and ("b.ts", 11, 15) in got


def test_analysis_holds_fragments_outside_blocks(spark):
    line = "value{0} = compute_something(data, opts{0}) + other{0} or default\n"
    text = "".join(line.format(i) for i in range(12))
    a = analyze(spark.createDataFrame([("a.py", "python", text), ("b.py", "python", "import os\n\n" + text)], SRC))
    found = a.issues["duplicate_code"].collect()
    assert found and {(r.file_a, r.name_a, r.file_b) for r in found} == {("a.py", "fragment", "b.py")}
    assert a.duplication.first()["duplicated_lines"] > 0 and a.unified.where("category = 'duplicate_code'").count() == len(found)


def test_patterns_and_distance(spark, rows):
    text = "const [user, setUser] = useState<User>();\n"
    df = spark.createDataFrame([(f"{i}.ts", "typescript", text * 3 + f"q{i} + r{i}\n") for i in range(4)] + [(f"z{i}.ts", "typescript", f"w{i}") for i in range(8)], SRC)
    top = {r.pattern: (r.file_count, r.occurrences) for r in patterns.scored_patterns(df).collect()}
    assert top["useState < User"] == (4, 12) and ") ;" not in top
    assert 0 < patterns.repetitive_patterns(df).count() <= 30
    assert patterns.repetitive_patterns(df.limit(2)).count() == 0
    long = "".join(f"const v{i} = call{i * 37 % 11}(arg{i});\n" for i in range(30))
    other = "".join(f"while ({i}) emit('{i * 7919}', {i * i});\n" for i in range(30))
    got = patterns.ncd_pairs(spark.createDataFrame([("a", "x", long), ("b", "x", long), ("c", "x", other)], SRC))
    assert [(r.path_a, r.path_b) for r in got.collect()] == [("a", "b")]


def test_distance_search_matches_brute_force(spark, rows):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=8))
    base = [[word() for _ in range(6)] for _ in range(30)]
    renamed = "".join(f"{' '.join(x)}\n" for x in ([*y[:2], "q", *y[3:]] for y in base))  # an edit every six tokens: hardly a common 8-gram
    first = "".join(f"{' '.join(x)}\n" for x in base)
    texts = {"a": first, "b": renamed, "c": first, "d": first, "e": "".join(f"{word()} {word()}\n" for _ in range(30)), "f": "short\n"}
    got = patterns.ncd_pairs(spark.createDataFrame([(p, "x", t) for p, t in texts.items()], SRC), chunk=2)
    size = lambda t: patterns._sizes([t])[0]
    far = lambda x, y: max(0.0, (size(x + y) - min(size(x), size(y))) / max(size(x), size(y)))
    want = {(p, q) for p in "abcde" for q in "abcde" if p < q and far(texts[p], texts[q]) <= 0.4}
    assert {(r.path_a, r.path_b) for r in got.collect()} == want and {("a", "b"), ("b", "c"), ("c", "d")} <= want


def test_distance_of_queries(spark):
    rng = random.Random(6)
    texts = {f"f{i:02d}": "".join(f"{rng.choice('abcdef') * 3} = {rng.randrange(9999)};\n" for _ in range(12)) for i in range(25)}
    texts["g"] = texts["f03"].replace("a", "b", 1)
    texts["h"] = texts["f05"]
    got = patterns.ncd_search(spark.createDataFrame([(p, "x", t) for p, t in texts.items()] + [("short", "x", "a\n"), (None, "x", texts["g"]), ("n", "x", None)], SRC), every=3, chunk=4)
    size = lambda t: patterns._sizes([t])[0]
    far = lambda x, y: max(0.0, (min(size(x + y), size(y + x)) - min(size(x), size(y))) / max(size(x), size(y)))
    heads = {t: min(p for p, s in texts.items() if s == t) for t in texts.values()}
    want = set()
    for t, p in heads.items():
        if int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) % 3 == 0:
            d = {q: far(t, s) for s, q in heads.items() if s != t}
            want |= {(p, q, v <= 0.4) for q, v in d.items() if v <= 0.4 or v == min(d.values())}
    assert {(r.path, r.other, r.near) for r in got.collect()} == want and want


def test_given_pairs_in_either_order(spark, tmp_path):
    spark.createDataFrame([("b.ts", "./a.ts", 0.1), ("a.ts", "c.ts", 0.1), ("c.ts", "a.ts", 0.2), ("a.ts", "a.ts", 0.0), ("a.ts", None, 0.1)], "path_a string, path_b string, distance double").write.parquet(f"{tmp_path}/ncd_candidates.parquet")
    files = [(p, "r", "typescript", f"export const {p[0]} = 1\n" * 20) for p in ("a.ts", "b.ts", "c.ts")]
    stamped = spark.createDataFrame(files, "path string, repo string, language string, source string").selectExpr("*", "timestamp'2025-01-01' AS scanned_at", "timestamp'2025-01-01' AS loaded_at")
    stamped.write.parquet(f"{tmp_path}/files.parquet")
    assert sorted((r.path_a, r.path_b) for r in core_queries.ncd_pairs(spark, str(tmp_path)).collect()) == [("a.ts", "b.ts"), ("a.ts", "c.ts")]


def test_entries(spark, rows):
    files = spark.createDataFrame([(p,) for p in ("next.config.js", "src/app/blog/page.tsx", "src/a.test.ts", "src/index.ts", "scripts/x.ts", "packages/ui/src/b.ts", "src/q.ts", "src/bin/t.rs")], "path string")
    profiles = workspaces.detect_frameworks(files, spark.createDataFrame([], "path string, source string"))
    assert profiles == ["nextjs", "generic"]
    got = rows(entries.entry_points(files, profiles, spark.createDataFrame([("./src/q.ts", "framework"), ("gone.ts", "framework")], "path string, class string"), spark.createDataFrame([("packages/ui/",)], "prefix string")))
    assert got == sorted([("next.config.js", "framework"), ("packages/ui/src/b.ts", "public_api"), ("scripts/x.ts", "implicit"), ("src/a.test.ts", "implicit"), ("src/app/blog/page.tsx", "framework"), ("src/bin/t.rs", "framework"), ("src/index.ts", "framework"), ("src/q.ts", "framework")], key=str)


def test_monorepos(spark, rows):
    def of(**texts):
        return spark.createDataFrame([(p.replace("_", ".", 1).replace("__", "-"), t) for p, t in texts.items()], "path string, source string")

    kind = lambda **t: workspaces.monorepo(of(**t))
    assert kind(package_json='{"workspaces": ["packages/*", "apps/**"]}') == ("npm/yarn", ["packages/", "apps/"])
    assert kind(package_json='{"workspaces": {"packages": ["libs/*"]}}', turbo_json="{}") == ("turborepo", ["libs/"])
    assert kind(package_json='{"devDependencies": {"nx": "1"}}') == ("nx", []) and kind(package_json="{}") == (None, []) and kind(package_json="{bad") == (None, [])
    assert workspaces.monorepo(spark.createDataFrame([("pnpm-workspace.yaml", "packages:\n  - 'packages/*'\n"), ("turbo.json", "{}")], "path string, source string")) == ("pnpm", ["packages/"])
    assert workspaces.monorepo(spark.createDataFrame([("package-lock.json", "{}")], "path string, source string")) == (None, [])
    assert workspaces.nx_plugins(of(package_json='{"dependencies": {"@nrwl/react": "1", "@nx/react": "1", "@nx/js": "1"}}')) == ["nx-react", "nx-js"]


WORKSPACE = [
    ("package.json", '{"name": "root", "main": "./lib/a.js", "exports": {".": "src/kept.ts", "./x": "./src/b.ts"}, "workspaces": ["packages/*"]}'), ("tsconfig.json", '{"files": ["src/t.ts"]}'),
    ("packages/ui/package.json", '{"name": "@r/ui", "module": "./dist/main.js", "exports": {".": {"import": "./src/api.js"}}, "dependencies": {"vue": "3"}}'),
    ("packages/app/package.json", '{"name": "app", "private": true, "main": "src/start"}'), ("packages/app/project.json", '{"projectType": "library", "targets": {"build": {"options": {"main": "./src/nx.ts"}}}}'),
    ("packages/tool/project.json", '{"sourceRoot": "code"}'), ("packages/.hidden/package.json", '{"name": "h", "main": "m.ts"}'), ("packages/bad/package.json", "{"),
]
SOURCES = ["lib/a.ts", "src/kept.ts", "src/b.ts", "src/t.ts", "packages/ui/dist/main.ts", "packages/ui/src/api.ts", "packages/ui/src/index.ts", "packages/ui-kit/x.ts", "packages/app/src/start/index.ts", "packages/app/src/nx.ts", "packages/tool/code/main.ts", "packages/.hidden/m.ts"]


def test_workspace_entries(spark, rows):
    texts, files = spark.createDataFrame(WORKSPACE, "path string, source string"), spark.createDataFrame([(p,) for p in SOURCES], "path string")
    kind, prefixes = workspaces.monorepo(texts)
    assert (kind, prefixes) == ("npm/yarn", ["packages/"])
    assert rows(workspaces.declared_by_manifests(texts, files, prefixes)) == sorted([
        ("lib/a.ts", "framework"), ("src/kept.ts", "framework"), ("src/t.ts", "framework"), ("packages/ui/dist/main.ts", "framework"), ("packages/ui/dist/main.ts", "public_api"), ("packages/ui/src/api.ts", "public_api"),
        ("packages/ui/src/index.ts", "framework"), ("packages/app/src/start/index.ts", "framework"), ("packages/app/src/start/index.ts", "public_api"), ("packages/app/src/nx.ts", "framework"), ("packages/app/src/nx.ts", "public_api"),
        ("packages/tool/code/main.ts", "framework"),
    ], key=str)
    assert rows(workspaces.published_dirs(texts)) == [("packages/.hidden",), ("packages/ui",)]
    api = rows(entries.entry_points(files, [], None, workspaces.published_dirs(texts)).where("class = 'public_api'").select("path"))
    assert api == [("packages/.hidden/m.ts",), ("packages/ui-kit/x.ts",), ("packages/ui/dist/main.ts",), ("packages/ui/src/api.ts",), ("packages/ui/src/index.ts",)]  # a folder's name is a beginning, with or without its slash
    assert workspaces.detect_frameworks(files, texts) == ["vue", "generic"]
    assert workspaces.detect_frameworks(spark.createDataFrame([("web/astro.config.ts",), ("tools/angular.json",), ("a/b/vue.config.js",)], "path string"), texts.limit(0)) == ["astro", "generic"]


PROJECT = [
    ("src/index.ts", "typescript", "import { used } from './live';\nimport x from 'left-pad';\nconsole.log(used);\n"), ("src/live.ts", "typescript", "export const used = 1;\nexport const idle = 2;\nimport './gone';\n"),
    ("src/dead.ts", "typescript", "export interface Lost { a: string }\nexport const idle = 3;\n"), ("src/a.ts", "typescript", "import './b';\n"), ("src/b.ts", "typescript", "import './a';\n"),
]


def test_reports_hold_every_issue(spark, rows):
    many = spark.range(20_000).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("path"), F.lit("n\u0001'\n").alias("name"))
    told = json.loads(reports.sarif({"unused_exports": many}))["runs"][0]["results"]
    assert len({r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in told}) == 20_000 and all("\n" not in r["message"]["text"] for r in told[:10])
    changes = spark.range(3_000).select(F.lit("new").alias("status"), F.lit("gotcha").alias("category"), F.format_string("f%05d|x", "id").alias("key")).union(spark.createDataFrame([("persisting", "gotcha", "p")], "status string, category string, key string"))
    net = spark.createDataFrame([("gotcha", 3000, 0, 3000)], "category string, new bigint, fixed bigint, net bigint")
    text = reports.diff_markdown(changes, net)
    assert text.count("| gotcha | f") == 3_000 and "f00007\\|x" in text and "+3000" in text and text.index("## new") < text.index("## persisting")
    assert len(json.loads(reports.diff_json(changes))["new_issues"]) == 3_000
    star = spark.createDataFrame([("src/hub.ts", f"src/a/l{i:02d}.ts") for i in range(40)] + [("src/far/x.ts", "src/far/y.ts")], "source string, target string")
    issues = spark.createDataFrame([("dead_code", "src/hub.ts", ["src/hub.ts"])], "category string, file string, files array<string>")
    chart = reports.mermaid(star, issues)
    assert chart.count("-->") == 40 and "y.ts" not in chart and 'subgraph "a"' in chart and " dead" in chart


def test_analysis_reports_and_fixes(spark, rows, tmp_path):
    registry = Registry()
    demo = registry.add(Plugin("demo", ("typescript",)))
    demo.hook("analyze_file")(lambda path, source, language: [{"rule": "r", "line": 1}] if "dead" in path else (_ for _ in ()).throw(ValueError("no")) if "live" in path else [])
    demo.hook("resolve_import")(lambda importer, spec: "src/a.ts" if spec == "./gone" else None)
    files = spark.createDataFrame(PROJECT, SRC)
    a = analyze(files, spark.createDataFrame([("package.json", "dependencies", "react")], "package_json string, section string, package string"), registry=registry)
    assert [r[0] for r in rows(a.issues["dead_code"])] == ["src/dead.ts"]
    assert rows(a.issues["unused_exports"].select("path", "name")) == [("src/dead.ts", "Lost"), ("src/dead.ts", "idle"), ("src/live.ts", "idle")]
    assert rows(a.issues["unused_types"]) == [("src/dead.ts", "Lost", "interface")]
    assert rows(a.issues["circular_dependencies"]) == [(("src/a.ts", "src/b.ts"),)]
    assert rows(a.issues["unlisted_dependencies"]) == [("src/index.ts", "left-pad")] and rows(a.issues["unused_dependencies"]) == [("react", "dependencies")]
    assert rows(a.issues["duplicate_exports"]) == [("idle", ("src/dead.ts", "src/live.ts"))] and a.issues["unresolved_imports"].count() == 0
    assert sorted(r.rule for r in a.issues["plugin_issues"].collect()) == ["plugin-error", "r"]
    s = a.summary().first()
    assert (s.total_files, s.dead_code, s.unused_exports, s.gotchas, s.unlisted_dependencies, s.unused_dependencies, s.duplicate_exports, s.plugin_issues, s.total_types) == (5, 1, 3, 1, 1, 1, 1, 2, 1) and s.health_score == 82.0
    assert {r["file"]: r["issues"] for r in summary.issues_per_file(a.unified).collect()} == {"src/dead.ts": 4, "src/live.ts": 1, "src/index.ts": 2, "src/a.ts": 1, "src/b.ts": 1}
    assert summary.has_issues(a.issues) and not summary.has_issues({})
    chained = [("src/index.ts", "typescript", "import { deepest } from './mid';\n"), ("src/mid.ts", "typescript", "export * from './far';\n"), ("src/far.ts", "typescript", "export const deepest = 1;\nexport const idle = 1;\n")]
    plain, deep = (analyze(spark.createDataFrame(chained, SRC), deep=d).issues["unused_exports"].select("path", "name") for d in (False, True))
    assert rows(plain) == [("src/far.ts", "deepest"), ("src/far.ts", "idle")] and rows(deep) == [("src/far.ts", "idle")]
    total, issues = a.summary(), a.unified
    told = json.loads(reports.json_report(a))
    assert told["summary"]["dead_code"] == 1 and told["detected_frameworks"] == [] and [x["path"] for x in told["issues"]["dead_code"]] == ["src/dead.ts"] and set(told["issues"]) == set(a.issues)
    found = json.loads(reports.sarif(a.issues, f"file://{tmp_path}/x.sarif") and (tmp_path / "x.sarif").read_text())["runs"][0]
    assert len(found["results"]) == sum(df.count() for k, df in a.issues.items() if k != "plugin_issues") and {r["ruleId"] for r in found["results"]} <= {r["id"] for r in found["tool"]["driver"]["rules"]}
    assert "src/dead.ts" in reports.markdown(total, issues) and "</script>" in reports.html(total, issues)
    assert len(json.loads(reports.ai_report(total, issues))["top_issues"]) == issues.where("impact is not null").count()
    assert reports.context(total, issues).count("\n") == 3 and reports.mermaid(a.edges, issues).startswith("graph LR")
    assert len(reports.pr_comment(total, issues).split("\n")) <= 6 and "health" in reports.dashboard(total, issues)
    assert [r[0] for r in reports.fix_hints(issues).collect()][0].startswith("# delete src/dead.ts")
    edits = fix.plan_export_edits(a.issues["unused_exports"], files)
    assert {r.status for r in edits.collect()} == {"planned"}
    fixed = {r.path: r.source for r in fix.edited_sources(edits, files).collect()}
    assert fixed["src/live.ts"].startswith("export const used = 1;\nconst idle = 2;") and fixed["src/dead.ts"].startswith("interface Lost")
    assert fix.strip_export("export const a = 1\nexport const a = 2\n", "a")[0] == "ambiguous"
    assert "react" not in fix.remove_dependencies('{"dependencies": {"react": "1", "b": "2"}}', ["react"])


def test_registry(spark):
    import pytest

    r = Registry()
    for n in "ab":
        r.add(Plugin(n, mode="override")).hook("format_output")(lambda kind, n=n: n)
    assert r.format("text", lambda: "built-in") == "built-in"
    del r.plugins["b"]
    assert r.format("text", lambda: "built-in") == "a"
    with pytest.raises(ValueError):
        r.add(Plugin("big", settings={"x": "y" * 70_000}))
    with pytest.raises(ValueError):
        Plugin("x").hook("nothing")


def test_watch(spark, tmp_path):
    from datetime import datetime

    schema = SRC + ", changed_at timestamp"
    feed, seen = str(tmp_path / "in"), []
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
    put([("a.ts", "typescript", "export const a = 1\n", datetime(2025, 1, 1)), ("a.ts", "typescript", "old", datetime(2024, 1, 1)), ("node_modules/x.ts", "typescript", "x", datetime(2025, 1, 1))])
    w = Watcher(spark, str(tmp_path / "state"), lambda files, facts: seen.append({r.path: list(r.exports) for r in facts.collect()}))
    w.start(feed, once=True).awaitTermination()
    put([("a.ts", "typescript", None, datetime(2025, 1, 2)), ("b.ts", "typescript", "export const b = 1\n", datetime(2025, 1, 2))])
    w.start(feed, once=True).awaitTermination()
    assert seen == [{"a.ts": ["a"]}, {"b.ts": ["b"]}]


def test_registered_queries_are_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_distance_search_makes_one_compressor_a_chunk(monkeypatch):
    made, real = [], zstandard.ZstdCompressor
    monkeypatch.setattr(zstandard, "ZstdCompressor", lambda **k: made.append(k) or real(**k))
    texts = {"a": "one two three\n" * 20, "b": "one two three\n" * 20 + "four\n", "c": "other words here, 1 2 3\n" * 9}
    pdf = pd.DataFrame([(p, t, asks) for asks in (True, False) for p, t in texts.items()], columns=["path", "source", "asks"])
    got = {(r.path, r.other): r.distance for r in patterns.nearest_texts(pdf, 1.0).itertuples()}
    size = lambda t: len(real(level=1).compress(t.encode()))
    for p, q in ((p, q) for p in texts for q in texts if p != q):
        joint = min(size(texts[p] + texts[q]), size(texts[q] + texts[p]))
        assert got[p, q] == min(1.0, max(0.0, (joint - min(size(texts[p]), size(texts[q]))) / max(size(texts[p]), size(texts[q]))))
    assert len(made) == 1


def test_fragments_without_a_partner_are_not_kept(spark, rows):
    """Only windows with a prefix fingerprint in another file go on, and the matches are those of all windows."""
    rnd = random.Random(5)
    text = lambda n: "".join(f"let {''.join(rnd.choices('abcdef', k=6))} = {rnd.random()} + other {rnd.random()};\n" for _ in range(n))
    both = text(14)
    data = spark.createDataFrame([("a.ts", "x", text(30) + both), ("b.ts", "x", both + text(20)), ("c.ts", "x", text(60)), ("d.ts", "x", both.replace("other", "thing", 1)), ("n.ts", "x", None)], SRC)
    all_windows, kept = rows(clones.fragments(data)), rows(clones.shared_fragments(data))
    assert kept and set(kept) < set(all_windows) and not [r for r in kept if r[0] == "c.ts"]
    sets = [(p, a, b, set(f)) for p, a, b, f in all_windows]
    alike = {s[:3] for s in sets for o in sets if s[0] != o[0] and s[2] - s[1] == o[2] - o[1] and len(s[3] & o[3]) >= 0.85 * len(s[3] | o[3])}
    assert alike and alike <= {r[:3] for r in kept}
    got = {side for r in clones.fragment_matches(data).collect() for side in ((r.path_a, r.start_a, r.end_a), (r.path_b, r.start_b, r.end_b))}
    assert got == alike


def test_merged_fragments_write_matching_windows_only(spark, rows, monkeypatch):
    written, real = {}, clones.materialize
    monkeypatch.setattr(clones, "materialize", lambda df, label: written.setdefault(label, real(df, label)))
    line = "let total = add(first, second) + price * count;\n"
    data = spark.createDataFrame([("a.ts", "x", line * 12), ("b.ts", "x", line * 12), ("c.ts", "x", "".join(f"word{i} other{i * 7} more{i * 11} last{i * 13}\n" for i in range(60)))], SRC)
    assert [r[:6] for r in rows(clones.merged_fragments(clones.fragment_matches(data)))] == [("a.ts", 1, 12, "b.ts", 1, 12)]
    assert {r.path for r in written["fragments"].select("path").distinct().collect()} == {"a.ts", "b.ts"}


def test_windows_share_the_hashes_of_their_text(monkeypatch):
    text = "\n".join(f"alpha{i} = beta{i % 3} + gamma{i % 7} * {i}" for i in range(40))
    want = [(at, at + 9, fingerprints.winnow(fingerprints.normal_words("\n".join(text.split("\n")[at - 1 : at + 9])), 8, 4, {})) for at in range(1, 32, 2)]
    monkeypatch.setattr(fingerprints, "winnow", None)  # hashes window by window
    assert list(fingerprints.windows_of(text, (10,), 8, 4)) == want


def test_fragments_are_merged_once(spark, rows, monkeypatch):
    written = []
    monkeypatch.setattr(clones, "materialize", lambda df, label: written.append(label) or df)
    frags = spark.createDataFrame([("a.ts", 1, 12, "b.ts", 1, 12, 1.0), ("a.ts", 30, 40, "b.ts", 50, 60, 0.9)], clones.MERGED)
    issues = spark.createDataFrame([("a.ts", 1, 20, "b.ts", 1, 15)], "file_a string, start_a bigint, end_a bigint, file_b string, start_b bigint, end_b bigint")
    assert rows(clones.not_covered(frags, issues)) == [("a.ts", 30, 40, "b.ts", 50, 60, 0.9)]
    assert written == ["merged-fragments", "block-places"]


def test_tables_on_the_way_to_matches_are_deleted(spark):
    line = "let total = add(first, second) + price * count;\n"
    data = spark.createDataFrame([("a.ts", "x", line * 12), ("b.ts", "x", line * 12)], SRC)
    before = len(getattr(spark.sparkContext, "_codeloom_paths", []))
    assert clones.fragment_matches(data).count()
    labels = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in spark.sparkContext._codeloom_paths[before:]]
    assert labels == ["fragments", *["fragment-matches"] * 3]
