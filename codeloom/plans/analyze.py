"""The whole analysis of a set of files, as lazy DataFrames over one table of facts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import clones, detect, entries as entry_ops, facts as fact_ops, graph, lint, patterns, state, summary
from codeloom.operators.resolve import crate_children, resolve_imports, resolve_rust
from codeloom.registry import PLUGIN_ISSUES, Registry
from codeloom.session import materialize
from codeloom.sources import manifests as manifest_ops, workspaces

FILTERED = ("dead_code", "duplicate_code", "gotchas")


@dataclass
class Analysis:
    files: DataFrame
    facts: DataFrame
    edges: DataFrame
    entries: DataFrame
    issues: dict[str, DataFrame]
    duplication: DataFrame
    unified: DataFrame
    instances: DataFrame
    frameworks: list[str] = field(default_factory=list)
    monorepo: tuple[str | None, list[str]] = (None, [])

    def summary(self) -> DataFrame:
        """One row of totals, counts and the health score."""
        return summary.summary(self.facts, fact_ops.exports(self.facts), self.unified, self.duplication)

    def patterns(self) -> DataFrame:
        """Token patterns that repeat across files."""
        return patterns.repetitive_patterns(self.files)


def analyze(
    files: DataFrame, manifest: DataFrame | None = None, aliases: DataFrame | None = None, declared: DataFrame | None = None, public: DataFrame | None = None, facts: DataFrame | None = None, registry: Registry | None = None,
    confidence: float = 0.0, deep: bool = False, manifests: DataFrame | None = None, paths: DataFrame | None = None, profiles: list[str] | None = None, baseline: DataFrame | None = None,
) -> Analysis:
    """Every detector over files (path, language, source).

    Files are parsed once; the facts are written to the shared folder and every
    detector reads them from there. ``manifests`` (path, source) holds the
    configuration files of the project and ``paths`` (path) all its paths, the
    files' own by default; packages, aliases, entries, published folders,
    frameworks and the kind of monorepo are read from them unless given:
    ``manifest`` is (package_json, section, package), ``aliases`` (scope_dir, ord,
    prefix, target), ``declared`` (path, class), ``public`` (prefix). Issues in
    ``baseline`` (fingerprint) and dead code, duplicates and findings below
    ``confidence`` are dropped before the summary. With ``deep`` an export is used
    too if it is imported through a chain of re-exporting files.
    """
    registry = registry or Registry()
    spark = files.sparkSession
    nothing = lambda schema: spark.createDataFrame([], schema)
    facts = facts if facts is not None else materialize(fact_ops.parse_files(files), "facts")
    kind, crates = (None, []), None
    if manifests is not None:
        kind = workspaces.monorepo(manifests)
        everything = (paths if paths is not None else files).select("path").union(manifests.select("path")).distinct()
        profiles = profiles if profiles is not None else workspaces.detect_frameworks(everything, manifests)
        manifest = manifest if manifest is not None else manifest_ops.package_deps(manifests.where("path = 'package.json'"))
        aliases = aliases if aliases is not None else manifest_ops.aliases(manifests)
        declared = declared if declared is not None else workspaces.declared_by_manifests(manifests, files, kind[1]).union(manifest_ops.declared_crates(manifests))
        public = public if public is not None else workspaces.published_dirs(manifests)
        crates = manifest_ops.crate_names(manifests)
    manifest = manifest if manifest is not None else nothing("package_json string, section string, package string")
    profiles = profiles if profiles is not None else workspaces.detect_frameworks((paths if paths is not None else files).select("path"), nothing("path string, source string"))
    scripts = resolve_imports(fact_ops.raw_imports(facts.where("language <> 'rust'")), facts.select("path"), aliases)
    if registry.active("resolve_import"):
        missing = scripts.where("target is null")
        scripts = scripts.where("target is not null").unionByName(registry.resolve(missing))
    rust = facts.where("language = 'rust'")
    uses = rust.select(F.col("path").alias("importer"), F.inline("named_imports")).select("importer", F.concat_ws("::", "spec", "name").alias("module"))
    mods = rust.select(F.col("path").alias("importer"), F.explode("modules").alias("m")).select("importer", F.concat(F.lit("mod::"), "m").alias("module"))
    found = resolve_rust(uses.union(mods), rust.select("path"), crates).where("target is not null").unionByName(crate_children(rust.select("path"))).distinct()
    resolved = materialize(scripts.unionByName(found.select("importer", F.col("module").alias("spec"), "target")), "resolved")
    edges = fact_ops.dep_edges(facts, resolved)
    used = F.when(F.col("spec").startswith("mod::"), F.lit("*")).otherwise(F.substring_index("spec", "::", -1))
    names = fact_ops.imported_names(facts, resolved).unionByName(resolved.where(F.col("spec").contains("::")).select("target", used.alias("name"), "importer")).distinct()
    entries = materialize(registry.entries(files, entry_ops.entry_points(facts.select("path"), profiles, declared, public)), "entries")
    framework = entries.where(F.col("class") == "framework").select("path").distinct()
    api = entries.where(F.col("class") == "public_api").select("path").distinct()
    loc = facts.select("path", "loc")
    dead = graph.dead_code(facts.select("path"), edges, entries, loc).unionByName(graph.framework_dead(facts.select("path"), edges, framework, entry_ops.implicit_only(entries), loc))
    stars = fact_ops.reexports(facts, resolved).where("name = '*'").select("barrel", "target")
    block_id = F.concat_ws("\t", "path", F.lpad(F.col("start_line").cast("string"), 9, "0"), F.lpad(F.col("end_line").cast("string"), 9, "0"), "name")
    members, pairs = clones.block_clones(fact_ops.blocks(facts).withColumn("block_id", block_id))
    places = fact_ops.blocks(facts).select(block_id.alias("id"), F.col("path").alias("file"), "name", "start_line", "end_line")
    block_issues = materialize(clones.located_issues(members, pairs, places), "block-duplicates")
    fragments = clones.not_covered(clones.merged_fragments(clones.fragment_matches(files)), block_issues).withColumns({"name_a": F.lit("fragment"), "name_b": F.lit("fragment")})
    fragments = fragments.withColumnsRenamed({"path_a": "file_a", "path_b": "file_b"}).select(*block_issues.columns)
    duplicates = materialize(block_issues.unionByName(fragments), "duplicates")
    instances = materialize(clones.clone_groups(duplicates), "instances")
    duplication = clones.duplication_stats(instances, facts.agg(F.coalesce(F.sum("total_lines"), F.lit(0)).alias("total_lines")))
    gotchas = lint.line_issues(files).drop("snippet")
    rules = tuple(r for r in lint.FILE_RULES if r.profile in profiles)
    for more in (lint.file_issues(files, rules), lint.unhandled_promises(files), lint.callback_hell(files), fact_ops.block_findings(facts).withColumn("snippet", F.lit(""))):
        gotchas = gotchas.unionByName(more.drop("snippet"))
    packages = fact_ops.external_imports(facts)
    issues = {
        "dead_code": dead,
        "unused_exports": detect.unused_exports(fact_ops.exports(facts), names, framework, api, detect.barrel_files(files)),
        "unused_types": detect.unused_types(detect.expand_star_types(fact_ops.type_exports(facts), stars), fact_ops.import_line_names(files), framework),
        "duplicate_code": duplicates,
        "gotchas": gotchas,
        "circular_dependencies": graph.circular_dependencies(edges.where("resolved")),
        "unused_dependencies": detect.unused_dependencies(manifest, packages),
        "unlisted_dependencies": detect.unlisted_dependencies(packages, manifest),
        "unresolved_imports": detect.unresolved_imports(edges),
        "duplicate_exports": detect.duplicate_exports(fact_ops.exports(facts)),
    }
    if deep:
        through = graph.used_through_reexports(issues["unused_exports"], names, fact_ops.reexports(facts, resolved))
        issues["unused_exports"] = issues["unused_exports"].join(through, ["path", "name"], "left_anti")
    plugin = registry.file_issues(files)
    issues["plugin_issues"] = plugin if plugin is not None else nothing(PLUGIN_ISSUES)
    if baseline is not None:
        issues = state.without_baselined(issues, baseline)
    issues = {k: detect.at_least(v, confidence) if k in FILTERED else v for k, v in issues.items()}
    # one job for each category: as one plan they take more of the driver's memory than all else
    found = reduce(DataFrame.unionByName, [materialize(summary.unified({k: v}), f"issues-{k}") for k, v in issues.items()])
    unified = materialize(registry.post(found), "issues") if registry.active("post_analysis") else found
    return Analysis(files, facts, edges, entries, issues, duplication, unified, instances, profiles, kind)
