"""Queries over the sample project, alone or beside the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions.predicates import is_example_directory, is_rust_lib_file
from codeloom.operators import detect, entries, facts, graph, lint, resolve, state, summary
from codeloom.plans import fix, reports, samples
from codeloom.plans.analyze import analyze
from codeloom.plans.tables import table
from codeloom.registry import Plugin, Registry
from codeloom.session import filesystem, shared_dir
from codeloom.sources import manifests, scan, snapshots, workspaces

SRC = "path string, source string"


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The table of files and the sample files."""
    return table(spark, d, "files").where("source is not null").select("path", "language", "source").distinct().unionByName(samples.sample_files(spark))


def _rows(rows: list[tuple], schema: str):
    return lambda spark: spark.createDataFrame(rows, schema)


def line_rules(spark: SparkSession, d: str) -> DataFrame:
    return lint.line_issues(_files(spark, d)).select("file", "line", "rule", "severity", "confidence")


def file_rules(spark: SparkSession, d: str) -> DataFrame:
    return lint.file_issues(_files(spark, d)).select("file", "line", "rule", "severity", "confidence")


def callback_hell(spark: SparkSession, d: str) -> DataFrame:
    return lint.callback_hell(_files(spark, d)).select("file", "line")


def unhandled_promises(spark: SparkSession, d: str) -> DataFrame:
    return lint.unhandled_promises(_files(spark, d)).select("file", "line")


def ordered_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the sample with their place in the order of reports."""
    found = lint.ordered(lint.line_issues(samples.sample_files(spark)))
    place = F.array(F.lit("critical"), F.lit("warning"), F.lit("info"))
    keyed = found.select(F.array_position(place, F.col("severity")).alias("s"), "file", "line", "rule")
    return keyed.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("s", "file", "line", "rule"))).select("place", "file", "line", "rule")


def barrels(spark: SparkSession, d: str) -> DataFrame:
    return detect.barrel_files(_files(spark, d))


def block_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings inside the blocks of the sample."""
    return facts.block_findings(facts.parse_files(samples.sample_files(spark))).select("file", "line", "rule", "severity", "confidence")


def function_counts(spark: SparkSession, d: str) -> DataFrame:
    """Functions and classes of the scripts whose text is a script's."""
    rows = table(spark, d, "files").where("classes is not null and functions is not null")
    f = facts.parse_files(rows.select("path", "language", "source").where("language in ('typescript', 'tsx', 'javascript', 'jsx')").where(~F.col("source").rlike(r"(?m)^(use [a-z_]+::|from \S+ import |import [a-z_]+\r?$|def |(pub )?fn )")))
    return f.select("path", "functions", "classes").distinct()


def sample_facts(spark: SparkSession, d: str) -> DataFrame:
    """Names, imports, types, re-exports, modules and blocks of the sample: path, fact, name, detail."""
    f = facts.parse_files(samples.sample_files(spark).where("path like 'src/names/%' or path like 'crate/%' or path like 'src/twin/%' or path like 'src/lint/nested%' or path like 'src/api/%'"))
    row = lambda kind, name, detail: F.struct(F.lit(kind).alias("fact"), name.alias("name"), detail.alias("detail"))
    parts = F.concat(
        F.transform("exports", lambda x: row("export", x, F.lit(""))), F.transform("imports", lambda x: row("import", x, F.lit(""))), F.transform("named_imports", lambda x: row("named", x["name"], x["spec"])),
        F.transform("type_exports", lambda x: row("type", x["name"], x["kind"])), F.transform("reexports", lambda x: row("reexport", x["name"], x["spec"])), F.transform("modules", lambda x: row("module", x, F.lit(""))),
        F.transform("blocks", lambda x: row("block", x["name"], F.concat_ws(" ", x["kind"], x["start_line"].cast("string"), x["end_line"].cast("string")))),
    )
    return f.select("path", F.inline(parts)).distinct()


def sample_metrics(spark: SparkSession, d: str) -> DataFrame:
    f = facts.parse_files(samples.sample_files(spark).unionByName(spark.createDataFrame([("tool.py", "python", "# a\n\nx = 1\n")], "path string, language string, source string")))
    return f.where("path in ('src/lint/nested.ts', 'src/lint/branches.ts', 'src/twin/a.ts', 'src/api/users.ts', 'crate/src/lib.rs', 'crate/src/parse/mod.rs', 'tool.py')").select("path", "loc", "total_lines", "functions", "classes", "complexity", "max_nesting_depth")


def _rust(spark: SparkSession) -> DataFrame:
    return facts.parse_files(samples.sample_files(spark).where("language = 'rust'"))


def rust_imports(spark: SparkSession, d: str) -> DataFrame:
    """importer, module, target of the sample crate, modules that its roots hold in their folder included."""
    f = _rust(spark)
    uses = f.select(F.col("path").alias("importer"), F.inline("named_imports")).select("importer", F.concat_ws("::", "spec", "name").alias("module"))
    mods = f.select(F.col("path").alias("importer"), F.explode("modules").alias("m")).select("importer", F.concat(F.lit("mod::"), "m").alias("module"))
    found = resolve.resolve_rust(uses.union(mods), f.select("path"), manifests.crate_names(samples.sample_manifests(spark)))
    return found.unionByName(resolve.crate_children(f.select("path"))).distinct().select("importer", "module", F.coalesce("target", F.lit("-")).alias("target"))


def entry_classes(spark: SparkSession, d: str) -> DataFrame:
    """Entries under the rules of every profile, one profile at a time, over the paths below their repository and the sample paths."""
    rel = table(spark, d, "files").select(F.regexp_replace("path", r"^[^/]+/", "").alias("path")).union(_rows([(p,) for p in samples.PROFILE_PATHS], "path string")(spark)).distinct()
    out = None
    for name in entries.PROFILES:
        part = entries.entry_points(rel, [name]).select(F.lit(name).alias("profile"), "path", "class")
        out = part if out is None else out.union(part)
    return out


def example_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    rows = table(spark, d, "files").select("path").union(_rows([(x,) for x in samples.PROFILE_PATHS], "path string")(spark)).distinct()
    return rows.select("path", is_example_directory(p).alias("example"), is_rust_lib_file(p).alias("crate_root"))


def implicit_entries(spark: SparkSession, d: str) -> DataFrame:
    rel = _rows([(x,) for x in samples.PROFILE_PATHS], "path string")(spark)
    return entries.implicit_only(entries.entry_points(rel, list(entries.PROFILES), None, _rows([("src/p",)], "prefix string")(spark)))


def manifest_packages(spark: SparkSession, d: str) -> DataFrame:
    return manifests.package_deps(samples.sample_manifests(spark).where("path like '%package.json'"))


def config_aliases(spark: SparkSession, d: str) -> DataFrame:
    return manifests.aliases(samples.sample_manifests(spark)).select(F.coalesce("scope_dir", F.lit("-")).alias("scope_dir"), "prefix", "target")


def scoped_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Specifiers of the sample workspace resolved by its own aliases."""
    ask = [("packages/ui/src/index.ts", "@/kept"), ("packages/web/x.ts", "#/a"), ("packages/web/code/y.ts", "#/b"), ("packages/app/z.ts", "#/a"), ("packages/app/z.ts", "@r/ui/src/api"), ("packages/app/z.ts", "@r/ui/parts/p"), ("packages/app/z.ts", "lib/start"), ("src/kept.ts", "./raw.js"), ("src/kept.ts", "./none"), ("src/kept.ts", "../../out")]
    files = [*samples.WORKSPACE_FILES, "packages/web/code/lib/a.ts", "packages/web/code/lib/b/index.tsx", "packages/ui/src/parts/p.ts"]
    got = resolve.resolve_imports(_rows(ask, "importer string, spec string")(spark), _rows([(p,) for p in files], "path string")(spark), manifests.aliases(samples.sample_manifests(spark)))
    return got.select("importer", "spec", F.coalesce("target", F.lit("-")).alias("target"))


def published_folders(spark: SparkSession, d: str) -> DataFrame:
    return workspaces.published_dirs(samples.sample_manifests(spark))


def public_files(spark: SparkSession, d: str) -> DataFrame:
    files = _rows([(p,) for p in samples.WORKSPACE_FILES], "path string")(spark)
    return entries.entry_points(files, [], None, workspaces.published_dirs(samples.sample_manifests(spark))).where("class = 'public_api'").select("path")


def crate_targets(spark: SparkSession, d: str) -> DataFrame:
    return manifests.declared_crates(samples.sample_manifests(spark))


def declared_entries(spark: SparkSession, d: str) -> DataFrame:
    texts = samples.sample_manifests(spark)
    return workspaces.declared_by_manifests(texts, _rows([(p,) for p in samples.WORKSPACE_FILES], "path string")(spark), workspaces.monorepo(texts)[1])


def monorepo_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for name in dict.fromkeys(r[0] for r in samples.ROOTS):
        texts = _rows([(p, s) for n, p, s in samples.ROOTS if n == name], SRC)(spark)
        kind, prefixes = workspaces.monorepo(texts)
        rows.append((name, kind or "-", ",".join(prefixes), ",".join(workspaces.nx_plugins(texts))))
    return spark.createDataFrame(rows, "root string, kind string, packages string, plugins string")


def detected_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """Frameworks shown by the root, by a workspace package and by a first-level folder."""
    none = [("nothing", "x.ts", None)]
    trees = [("root file", "next.config.js", None), ("root file", "payload.config.ts", None), ("root package", "package.json", '{"dependencies": {"@nestjs/core": "1", "svelte": "1"}}'), ("workspace", "package.json", '{"workspaces": ["packages/*"]}'), ("workspace", "packages/ui/package.json", '{"devDependencies": {"vue": "3"}}'),
             ("folder", "web/astro.config.ts", None), ("folder", "tools/angular.json", None), ("own name", "package.json", '{"name": "shadcn"}'), *none]
    rows = []
    for name in dict.fromkeys(t[0] for t in trees):
        mine = [(p, s) for n, p, s in trees if n == name]
        got = workspaces.detect_frameworks(_rows([(p,) for p, _ in mine], "path string")(spark), _rows([(p, s) for p, s in mine if s is not None], SRC)(spark))
        rows.append((name, ",".join(got)))
    return spark.createDataFrame(rows, "project string, frameworks string")


def scanned_tree(spark: SparkSession, d: str) -> DataFrame:
    """Files found in a tree that is written first: sources, and configuration files at its root."""
    root = shared_dir(spark, "tree")
    for path, text in {**samples.TREE, "bad.ts": b"\xff\xfe\xfa", "big.ts": "x" * (scan.MOST_BYTES + 1)}.items():
        fs, at = filesystem(spark, f"{root}/{path}")
        out = fs.create(at, True)
        out.write(bytearray(text if isinstance(text, bytes) else text.encode()))
        out.close()
    tree = scan.read_tree(spark, root)
    found = scan.discover_source_files(tree).select("path", F.lit("source").alias("kind"), "language")
    return found.union(scan.discover_config_files(tree).select("path", F.lit("config"), F.lit("-"))).union(scan.read_sources(tree).select("path", F.lit("read"), "language"))


def excluded_paths(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the table's paths under globs with one and two stars."""
    return scan.filter_excluded(table(spark, d, "files").select("path").distinct(), ["orchard-monorepo/**", "*/src/*/*.ts", "**.py", "*/tests/**"])


def saved_states(spark: SparkSession, d: str) -> DataFrame:
    """A baseline, a guard manifest and an analysis, written and read again."""
    root = shared_dir(spark, "saved")
    prints = table(spark, d, "ai_issues").where("file is not null").select(F.concat_ws("::", "category", "file").alias("fingerprint"))
    snapshots.save_baseline(state.make_baseline(prints), f"{root}/baseline.json", "2025-05-01")
    guard = table(spark, d, "files").where("source is not null").groupBy("path").agg(F.min(tx.guard_hash(F.col("source"))).alias("hash")).withColumn("description", F.lit(None).cast("string"))
    snapshots.save_guard(guard, f"{root}/guard.json")
    issues = table(spark, d, "ai_issues").where("file is not null and line is not null").select("file", "line").distinct()
    snapshots.save_analysis(issues, f"{root}/analysis")
    a = snapshots.load_baseline(spark, f"{root}/baseline.json").select(F.lit("baseline").alias("kind"), F.col("fingerprint").alias("key"), F.lit("").alias("value"))
    b = snapshots.load_guard(spark, f"{root}/guard.json").select(F.lit("guard"), "path", "hash")
    c = snapshots.load_analysis(spark, f"{root}/analysis", "file string, line bigint").select(F.lit("analysis"), "file", F.col("line").cast("string"))
    return a.union(b).union(c)


def guard_updates(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of guarded files after adding, removing and renewing some."""
    f = table(spark, d, "files").where("source is not null").groupBy("path").agg(F.min("source").alias("source"))
    stale = f.where("path like '%/src/%'").select("path", F.lit("sha256:old").alias("hash"), F.lit("kept").alias("description"))
    added = state.guard_add(stale, f.where("path like '%.rs'"), F.lit("rust"))
    fewer = state.guard_remove(added, f.where("path like '%/core/%'").select("path"))
    return state.guard_update(fewer, f.where("path like '%.py'")).select("path", "hash", "description")


def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites of texts for reports, over all documents."""
    t = F.col("text")
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    h = tx.content_hash
    return rows.select(
        "doc_id", h(tx.truncate_bytes(tx.trim_all(t), 120, 117)).alias("line"), h(tx.truncate_bytes(t, 200, 200)).alias("snippet"), h(tx.mermaid_label(t)).alias("label"), h(tx.mermaid_id(t)).alias("ident"), h(tx.shell_quote(t)).alias("quoted"),
        h(tx.strip_ansi(F.concat(F.lit("\x1b[31m"), t, F.lit("\x1b[0m")))).alias("plain"), h(tx.unquote(F.concat(F.lit("`"), t, F.lit("`")))).alias("bare"), h(tx.markdown_cell(t)).alias("cell"), tx.relative_to(F.concat(F.lit("/r/s/"), F.col("doc_id").cast("string")), "/r/s").alias("rest"),
    )


def common_folders(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files").select("repo", "language", "path").where("repo is not null and language is not null")
    return files.groupBy("repo", "language").agg(F.collect_set("path").alias("p")).select("repo", "language", tx.common_prefix_dir(F.col("p")).alias("folder"))


def issue_identities(spark: SparkSession, d: str) -> DataFrame:
    """Key and fingerprint of an issue of each category."""
    r = lambda rows, schema: _rows(rows, schema)(spark)
    issues = {
        "dead_code": r([("a.ts",)], "path string"), "unused_exports": r([("a.ts", "x")], "path string, name string"), "unused_types": r([("a.ts", "T", "type")], "path string, name string, kind string"),
        "duplicate_code": r([("a", 1, 5, "b", 2, 6)], "file_a string, start_a bigint, end_a bigint, file_b string, start_b bigint, end_b bigint"), "gotchas": r([("a.ts", 3, "eval-usage")], "file string, line bigint, rule string"),
        "circular_dependencies": r([(["a", "b"],)], "files array<string>"), "duplicate_exports": r([("x", ["a", "b"])], "name string, locations array<string>"), "unresolved_imports": r([("a", "./b")], "source string, spec string"),
        "unused_dependencies": r([("p", "dependencies")], "package string, section string"), "unlisted_dependencies": r([("a", "p")], "path string, package string"),
    }
    return state.analysis_keys(issues).select("category", "key", F.coalesce("fingerprint", F.lit("-")).alias("fingerprint"))


def reexport_chains(spark: SparkSession, d: str) -> DataFrame:
    """Unused exports of the sample that are imported through files which re-export them."""
    f = facts.parse_files(samples.sample_files(spark).where("path like 'src/names/%'"))
    got = resolve.resolve_imports(facts.raw_imports(f), f.select("path"))
    unused = detect.unused_exports(facts.exports(f), facts.imported_names(f, got))
    return graph.used_through_reexports(unused, facts.imported_names(f, got), facts.reexports(f, got))


def star_types(spark: SparkSession, d: str) -> DataFrame:
    f = facts.parse_files(samples.sample_files(spark).where("path like 'src/names/%'"))
    got = resolve.resolve_imports(facts.raw_imports(f), f.select("path"))
    return detect.expand_star_types(facts.type_exports(f), facts.reexports(f, got).where("name = '*'").select("barrel", "target")).distinct()


def imported_names(spark: SparkSession, d: str) -> DataFrame:
    f = facts.parse_files(samples.sample_files(spark).where("path like 'src/names/%'"))
    return facts.imported_names(f, resolve.resolve_imports(facts.raw_imports(f), f.select("path")))


def _plugins() -> Registry:
    registry = Registry()
    demo = registry.add(Plugin("demo", ("typescript",)))
    demo.hook("analyze_file")(lambda path, source, language: [{"rule": "marked", "line": 1, "severity": "warning"}] if "twin" in path else (_ for _ in ()).throw(ValueError("no")) if "ring/a" in path else [])
    demo.hook("resolve_import")(lambda importer, spec: "src/names/far.ts" if spec == "./gone" else None)
    demo.hook("discover_entries")(lambda files: files.where("path like 'src/ring/%'").select("path", F.lit("implicit").alias("class")))
    demo.hook("post_analysis")(lambda issues: issues.where("category = 'circular_dependencies'").withColumn("reason", F.lit("seen after")))
    return registry


def plugin_results(spark: SparkSession, d: str) -> DataFrame:
    """What each hook of a plug-in adds on the sample: hook, path, value."""
    files, registry = samples.sample_files(spark), _plugins()
    a = registry.file_issues(files).select(F.lit("analyze_file").alias("hook"), F.col("file").alias("path"), "rule")
    b = registry.resolve(_rows([("src/index.ts", "./gone"), ("src/index.ts", "./lost")], "importer string, spec string")(spark)).select(F.lit("resolve_import"), "spec", F.coalesce("target", F.lit("-")))
    c = registry.entries(files, _rows([("x.ts", "framework")], "path string, class string")(spark)).select(F.lit("discover_entries"), "path", "class")
    e = registry.post(_rows([("circular_dependencies", "a", "first"), ("gotchas", "b", "kept")], "category string, file string, reason string")(spark)).select(F.lit("post_analysis"), "file", "reason")
    return a.union(b).union(c).union(e)


def fix_plan(spark: SparkSession, d: str) -> DataFrame:
    """Edits that would remove exports of the sample, and why others are left alone."""
    rows = [("src/names/far.ts", "idle"), ("src/names/first.ts", "walk"), ("src/names/first.ts", "Kind"), ("src/names/first.ts", "first"), ("src/names/index.ts", "Other"), ("src/api/users.ts", "Users"), ("src/app/params.ts", "generateStaticParams")]
    return fix.plan_export_edits(_rows(rows, "path string, name string")(spark), samples.sample_files(spark))


def bracket_errors(spark: SparkSession, d: str) -> DataFrame:
    broken = [("a.ts", "typescript", "f(a;\n}\n"), ("b.tsx", "tsx", "const a = <p>{x}</p>;\nif (a) {\n"), ("c.js", "javascript", "const t = `a${b}`;\n")]
    return facts.parse_errors(facts.parse_files(spark.createDataFrame(broken, "path string, language string, source string").unionByName(samples.sample_files(spark))))


def _analysis(spark: SparkSession):
    texts = samples.sample_manifests(spark)
    return analyze(samples.sample_files(spark), manifests=texts.where("path = 'package.json' or path like 'crate/%'"), registry=_plugins(), profiles=["nextjs", "nestjs", "generic"])


def sample_summary(spark: SparkSession, d: str) -> DataFrame:
    """The whole analysis of the sample project in one row."""
    return _analysis(spark).summary()


def sample_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of the sample project but those of lines: category, file, reason."""
    return _analysis(spark).unified.where("category not in ('gotchas', 'duplicate_code')").select("category", "file", "reason")


def sarif_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rule, level and place of the results in the exchange format, for one issue of each kind."""
    r = lambda rows, schema: _rows(rows, schema)(spark)
    issues = {
        "dead_code": r([("a.ts", 10, 0.95, "x"), ("b\\c.ts", 1, 0.7, "x")], "path string, lines_of_code bigint, confidence double, reason string"), "unused_exports": r([("a.ts", "x")], "path string, name string"), "unused_types": r([("a.ts", "T", "type")], "path string, name string, kind string"),
        "duplicate_code": r([("a", 1, 5, "b", 2, 6, 0.75)], "file_a string, start_a bigint, end_a bigint, file_b string, start_b bigint, end_b bigint, confidence double"),
        "gotchas": r([("a.ts", 3, "eval-usage", "critical", "m", 0.9), ("a.ts", 4, "any-type", "warning", "m", 0.9)], "file string, line bigint, rule string, severity string, message string, confidence double"),
        "circular_dependencies": r([(["a", "b"],)], "files array<string>"), "duplicate_exports": r([("x", ["a", "b"])], "name string, locations array<string>"), "unresolved_imports": r([("a", "./b")], "source string, spec string"),
        "unused_dependencies": r([("p", "dependencies")], "package string, section string"), "unlisted_dependencies": r([("a", "p")], "path string, package string"),
    }
    got = json.loads(reports.sarif(issues))["runs"][0]["results"]
    rows = [(x["ruleId"], x["level"], ",".join(f"{p['physicalLocation']['artifactLocation']['uri']}:{p['physicalLocation']['region']['startLine']}" for p in x["locations"])) for x in got]
    return spark.createDataFrame(rows, "rule string, level string, places string")


def failing(spark: SparkSession, d: str) -> DataFrame:
    """Whether issues of each category alone make a run fail."""
    one = _rows([(1,)], "x int")(spark)
    return spark.createDataFrame([(c, summary.has_issues({c: one}), summary.has_issues({c: one.limit(0)})) for c in summary.UNIFIED], "category string, fails boolean, fails_empty boolean")


def cache_runs_of_facts(spark: SparkSession, d: str) -> DataFrame:
    """Paths in the fact cache after a run over fewer and changed files."""
    cache = facts.FactCache(spark, shared_dir(spark, "facts-cache"))
    files = samples.sample_files(spark)
    cache.refresh(files)
    changed = files.where("path not like 'crate/%'").withColumn("source", F.when(F.col("path") == "src/ring/a.ts", F.lit("export const q = 1;\n")).otherwise(F.col("source")))
    got = cache.refresh(changed)
    return got.select("path", F.col("sha").alias("sha"))


_ALL = (
    line_rules, file_rules, callback_hell, unhandled_promises, ordered_findings, barrels, block_findings, function_counts, sample_facts, sample_metrics, rust_imports, entry_classes, example_paths, implicit_entries, manifest_packages, config_aliases, scoped_resolution, published_folders, public_files,
    crate_targets, declared_entries, monorepo_kinds, detected_frameworks, scanned_tree, excluded_paths, saved_states, guard_updates, text_helpers, common_folders, issue_identities, reexport_chains, star_types, imported_names, plugin_results, fix_plan, bracket_errors, sample_summary, sample_issues, sarif_rows, failing, cache_runs_of_facts,
)
QUERIES = {f.__name__: f for f in _ALL}
