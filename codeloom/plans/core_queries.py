"""Queries of the core operators over the driver's tables, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions.paths import location
from codeloom.functions.predicates import is_example_or_script, is_test_file, is_test_fixture, within_root
from codeloom.operators import clones, detect, entries, facts, graph, lint, patterns, resolve, state, summary
from codeloom.operators.incremental import replay_runs
from codeloom.plans.analyze import analyze
from codeloom.plans.tables import table
from codeloom.session import materialize, shared_dir
from codeloom.sources.scan import glob_regex, is_skipped, language_of
from codeloom.sources.snapshots import latest_entries
from codeloom.streaming.watch import Watcher

SCRIPTS = ("typescript", "tsx", "javascript", "jsx")
CATEGORY_NAMES = {"unused_export": "unused_exports", "unused_type": "unused_types", "gotcha": "gotchas", "circular_dependency": "circular_dependencies"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return replay_runs(table(spark, d, "cache_entries"), table(spark, d, "cache_runs"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").where("source is not null").select("path", "language", "source").distinct()


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return latest_entries(table(spark, d, "cache_entries"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select(F.col("path").alias("source"), F.explode("dep_targets").alias("target")).distinct()


def dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return graph.dead_code(e.select("path"), _edges(spark, d), e.where("path like '%/tests/%'").select("path"), e.select("path", "loc"))


def seeded_dead(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return graph.framework_dead(e.select("path"), _edges(spark, d), e.where("path like '%/tests/%'").select("path"), e.where("path like '%/scripts/%'").select("path"), e.select("path", "loc"), "^[^/]+/(src|__mocks__|scripts)/")


def cycles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    one = c.agg(F.count(F.lit(1)).alias("n"))
    edges = c.crossJoin(F.broadcast(one)).select(F.col("c_custkey").cast("string").alias("source"), ((F.col("c_custkey") * 7 + 3) % F.col("n")).cast("string").alias("target"))
    return graph.circular_dependencies(edges).select(F.array_join("files", ">").alias("cycle"))


def import_cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.circular_dependencies(_edges(spark, d)).select(F.array_join("files", ">").alias("cycle"))


def import_components(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.components(e.select(F.col("source").alias("a"), F.col("target").alias("b"))).withColumnRenamed("group", "least")


def python_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbourhood(_edges(spark, d), table(spark, d, "files").where("language = 'python'").select("path"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.parse_files(_files(spark, d))


def exported_names(spark: SparkSession, d: str) -> DataFrame:
    return facts.exports(_facts(spark, d)).distinct()


def external_packages(spark: SparkSession, d: str) -> DataFrame:
    return facts.external_imports(_facts(spark, d))


def unused_types(spark: SparkSession, d: str) -> DataFrame:
    return detect.unused_types(facts.type_exports(_facts(spark, d)), facts.import_line_names(table(spark, d, "files"))).distinct()


def duplicate_exports(spark: SparkSession, d: str) -> DataFrame:
    return detect.duplicate_exports(facts.exports(_facts(spark, d)).distinct()).select("name", F.array_join("locations", ",").alias("locations"))


def unused_exports(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    pair = li.select(F.concat(F.lit("src/part"), F.col("l_partkey"), F.lit(".ts")).alias("path"), F.col("l_suppkey").cast("string").alias("name"), "l_returnflag")
    return detect.unused_exports(pair.select("path", "name").distinct(), pair.where("l_returnflag = 'R'").select(F.col("path").alias("target"), "name"))


def unresolved_imports(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    r = resolve.resolve_imports(facts.raw_imports(f), table(spark, d, "files").select("path"))
    return detect.unresolved_imports(facts.dep_edges(f, r))


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "cache_entries").where("run_id <= 2")
    return old.select(F.col("path").alias("package_json"), F.lit("dependencies").alias("section"), F.explode("external_specs").alias("s")).select("package_json", "section", tx.package_name(F.col("s")).alias("package")).distinct()


def _packages(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("path", F.explode("external_specs").alias("s")).select("path", tx.package_name(F.col("s")).alias("package")).distinct()


def unused_deps(spark: SparkSession, d: str) -> DataFrame:
    return detect.unused_dependencies(_manifest(spark, d), _packages(spark, d).where("path like '%/src/%'"))


def unlisted_deps(spark: SparkSession, d: str) -> DataFrame:
    return detect.unlisted_dependencies(_packages(spark, d), _manifest(spark, d).where("package_json like '%/tests/%'"))


def line_metrics(spark: SparkSession, d: str) -> DataFrame:
    loc, total = tx.count_loc(F.col("source"))
    return _files(spark, d).select("path", loc.alias("loc"), total.alias("total_lines"))


def lookahead_rule(spark: SparkSession, d: str) -> DataFrame:
    return lint.lookahead(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase").select("event_id", "user_id")


def blocks_found(spark: SparkSession, d: str) -> DataFrame:
    """Blocks read from the sources that are in the table of blocks too."""
    mine = facts.blocks(_facts(spark, d)).select("path", "start_line", "end_line").distinct()
    return mine.join(table(spark, d, "blocks").select("path", "start_line", "end_line").distinct(), ["path", "start_line", "end_line"], "left_semi")


def _clones(spark: SparkSession, d: str):
    blocks = table(spark, d, "blocks").select("block_id", "path", "name", "start_line", "end_line", "source").distinct()
    members, pairs = clones.block_clones(blocks)
    places = blocks.select(F.col("block_id").alias("id"), F.col("path").alias("file"), "name", "start_line", "end_line").dropDuplicates(["id"])
    return members, pairs, places


def block_clones(spark: SparkSession, d: str) -> DataFrame:
    _, pairs, _ = _clones(spark, d)
    return pairs.select("a", "b", tx.round2(F.col("similarity")).alias("confidence"))


def block_clone_members(spark: SparkSession, d: str) -> DataFrame:
    return _clones(spark, d)[0].withColumnRenamed("class", "class_id")


def _instances(spark: SparkSession, d: str) -> DataFrame:
    return materialize(clones.clone_groups(clones.located_issues(*_clones(spark, d))), "instances")


def clone_groups(spark: SparkSession, d: str) -> DataFrame:
    i = _instances(spark, d)
    key = F.min(F.struct("file", "start_line", "end_line"))
    heads = i.groupBy("group_id").agg(key.alias("k"))
    return i.join(heads, "group_id").select(F.concat_ws("|", "k.file", "k.start_line", "k.end_line").alias("group_key"), "file", "start_line", "end_line")


def _importer_groups(spark: SparkSession, d: str) -> DataFrame:
    """The importers of a file as instances of one group."""
    loc = _entries(spark, d).select(F.col("path").alias("source"), F.coalesce("loc", F.lit(0)).alias("loc"))
    return _edges(spark, d).join(loc, "source").select(F.xxhash64("target").alias("group_id"), F.col("source").alias("file"), F.lit(1).cast("bigint").alias("start_line"), (F.col("loc") % 40 + 5).alias("end_line"))


def clone_families(spark: SparkSession, d: str) -> DataFrame:
    return clones.clone_families(_importer_groups(spark, d))


def mirrored_dirs(spark: SparkSession, d: str) -> DataFrame:
    return clones.mirrored_directories(_importer_groups(spark, d)).select("dir_a", "dir_b", F.array_join("files", ",").alias("files"), "lines")


def dup_stats(spark: SparkSession, d: str) -> DataFrame:
    _, total = tx.count_loc(F.col("source"))
    lines = _files(spark, d).agg(F.sum(total).alias("total_lines"))
    return clones.duplication_stats(_instances(spark, d), lines).withColumn("duplication_percentage", F.round("duplication_percentage", 6))


def fragment_clones(spark: SparkSession, d: str) -> DataFrame:
    m = clones.fragment_matches(_files(spark, d))
    return m.withColumn("confidence", tx.round2(F.col("confidence")))


def merged_fragments(spark: SparkSession, d: str) -> DataFrame:
    members, pairs, places = _clones(spark, d)
    return clones.not_covered(clones.merged_fragments(clones.fragment_matches(_files(spark, d))), clones.located_issues(members, pairs, places))


def ngram_patterns(spark: SparkSession, d: str) -> DataFrame:
    return patterns.top_patterns(_files(spark, d).dropDuplicates(["path"]))


def repetitive_patterns(spark: SparkSession, d: str) -> DataFrame:
    return patterns.repetitive_patterns(_files(spark, d).dropDuplicates(["path"])).select("pattern", "file_count", "occurrences", "info_score", F.array_join("example_files", ",").alias("example_files"))


def ncd_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "ncd_candidates").select(location(F.col("path_a")).alias("path_a"), location(F.col("path_b")).alias("path_b"))
    oriented = pairs.where("path_a <> path_b").select(F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b"))
    return patterns.ncd_distance(oriented, _files(spark, d)).withColumn("distance", F.round("distance", 4))


def ncd_search(spark: SparkSession, d: str) -> DataFrame:
    return patterns.ncd_search(_files(spark, d)).withColumn("distance", F.round("distance", 4))


def _unified(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ai_issues").select("issue_id", "category", "file", "line", "impact", "confidence", "suggested_action", "reason").distinct()
    name = F.col("category")
    for a, b in CATEGORY_NAMES.items():
        name = F.when(F.col("category") == a, b).otherwise(name)
    return rows.withColumn("category", name)


def top_issues(spark: SparkSession, d: str) -> DataFrame:
    return summary.top_issues(_unified(spark, d), 20, ["issue_id"]).select("issue_id", "category", "file", "impact")


def files_at_risk(spark: SparkSession, d: str) -> DataFrame:
    return summary.files_at_risk(_unified(spark, d))


def issues_per_file(spark: SparkSession, d: str) -> DataFrame:
    return summary.issues_per_file(_unified(spark, d))


def top_risk_file(spark: SparkSession, d: str) -> DataFrame:
    return summary.top_risk_file(_unified(spark, d).where("category = 'unused_exports' and file is not null").select(F.col("file").alias("path")))


def category_leaders(spark: SparkSession, d: str) -> DataFrame:
    rows = _unified(spark, d).where(F.col("impact").isNotNull() & ~F.isnan("impact"))
    return detect.top_of_each(rows, ["category"], [F.desc("impact"), F.asc("issue_id")], 5).select("category", "rank", "issue_id")


def first_finding(spark: SparkSession, d: str) -> DataFrame:
    rows = _unified(spark, d).where("category = 'gotchas' and file is not null and line is not null")
    return detect.first_of_each(rows, ["file"], [F.asc("line"), F.asc("issue_id")]).select("file", "line", "issue_id")


def confident_issues(spark: SparkSession, d: str) -> DataFrame:
    return detect.at_least(_unified(spark, d), 0.8).groupBy("category").agg(F.count(F.lit(1)).alias("issues"))


def health_score(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "files").select("path").distinct().agg(F.count(F.lit(1)).alias("total_files"))
    i = _unified(spark, d).where(F.col("category").isin(*summary.SCORED) & (F.col("issue_id") > 0)).where("confidence >= 0.95").agg(F.count(F.lit(1)).alias("total_issues"))
    return summary.health_score(n.crossJoin(F.broadcast(i)).withColumn("duplication_percentage", F.lit(12.5)))


def _snapshots(spark: SparkSession, d: str):
    rows = table(spark, d, "ai_issues").where("file is not null and category is not null").select("reported_at", "category", F.concat_ws(":", "file", F.coalesce(F.col("line").cast("string"), F.lit("-"))).alias("key")).distinct()
    return rows.where("reported_at < timestamp'2025-05-01 00:00:00'").select("category", "key").distinct(), rows.where("reported_at >= timestamp'2025-05-01 00:00:00'").select("category", "key").distinct()


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    return state.diff(*_snapshots(spark, d))


def diff_net(spark: SparkSession, d: str) -> DataFrame:
    return state.diff_net(snapshot_diff(spark, d))


def baseline_apply(spark: SparkSession, d: str) -> DataFrame:
    before, after = _snapshots(spark, d)
    prints = lambda df: df.select(F.concat("category", F.lit("::"), "key").alias("fingerprint"))
    return state.apply_baseline(prints(after), state.make_baseline(prints(before)))


def guard_check(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").where("source is not null and sha256 is not null").groupBy("path").agg(F.min_by(F.struct("source", "sha256"), "loaded_at").alias("f")).select("path", "f.*")
    manifest = f.select("path", F.concat(F.lit("sha256:"), F.regexp_replace(F.lower("sha256"), "^sha256:", "")).alias("hash"), F.lit("").alias("description"))
    return state.guard_check(manifest, f.where("path not like '%/tests/%'")).select("path", "status")


def guard_counts(spark: SparkSession, d: str) -> DataFrame:
    return state.guard_summary(guard_check(spark, d))


def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    bare = F.regexp_replace("target", r"\.[a-z]+$", "")
    spec = F.when(F.col("target").startswith("orchard-monorepo/"), F.concat(F.lit("@orchard/"), F.substring(bare, len("orchard-monorepo/") + 1, 1000))).otherwise(bare)
    aliases = spark.createDataFrame([(None, 0, "@orchard/", "orchard-monorepo")], "scope_dir string, ord int, prefix string, target string")
    return resolve.resolve_imports(e.select(F.col("source").alias("importer"), spec.alias("spec")), table(spark, d, "files").select("path"), aliases)


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text", "path").distinct().select(
        "doc_id", tx.content_hash(tx.normalized(t)).alias("normal"), tx.content_hash(t).alias("sha"), F.size(tx.words(tx.normalized(t))).alias("words"), tx.parent_dir(F.col("path")).alias("dir"), tx.file_name(F.col("path")).alias("file"),
        F.octet_length(t).alias("octets"), F.size(tx.pattern_tokens(t)).alias("tokens"), tx.content_hash(tx.markdown_escape(t)).alias("escaped"),
    )


def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return table(spark, d, "files").select("path").distinct().select(
        "path", is_test_file(p).alias("test"), is_test_fixture(p).alias("fixture"), is_example_or_script(p).alias("script"), is_skipped(p).alias("skipped"), language_of(p).alias("language"), within_root(F.concat(p, F.lit("/../../x"))).alias("inside"), p.rlike(glob_regex("*/src/**")).alias("globbed"),
    )


def file_facts(spark: SparkSession, d: str) -> DataFrame:
    f = facts.parse_files(_files(spark, d))
    return f.select("path", "language", "loc", "total_lines", "functions", "classes", "complexity", "max_nesting_depth", F.size("exports").alias("exports"), F.size("imports").alias("imports"))


def watched_languages(spark: SparkSession, d: str) -> DataFrame:
    root = shared_dir(spark, "watch")
    table(spark, d, "files").select("path", "language", "source", F.col("loaded_at").alias("changed_at")).write.parquet(f"{root}/in")
    last: dict[str, DataFrame] = {}
    Watcher(spark, f"{root}/state", lambda files, parsed: last.update(parsed=parsed)).start(f"{root}/in", once=True).awaitTermination()
    return last["parsed"].groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def analysis_summary(spark: SparkSession, d: str) -> DataFrame:
    # one text for each path, the same in every use; they are read many times, so they are written first
    texts = table(spark, d, "files").where("source is not null").groupBy("path").agg(F.min(F.struct("language", "source")).alias("f"))
    return analyze(materialize(texts.select("path", "f.language", "f.source"), "texts")).summary()


_ALL = (
    p1_found, dead_nodes, seeded_dead, cycles, import_cycles, import_components, python_neighbours, exported_names, external_packages, unused_types, duplicate_exports, unused_exports, unresolved_imports, unused_deps, unlisted_deps,
    line_metrics, lookahead_rule, blocks_found, block_clones, block_clone_members, clone_groups, clone_families, mirrored_dirs, dup_stats, fragment_clones, merged_fragments,
    ngram_patterns, repetitive_patterns, ncd_pairs, ncd_search, top_issues, files_at_risk, issues_per_file, top_risk_file, category_leaders, first_finding, confident_issues, health_score, snapshot_diff, diff_net, baseline_apply,
    guard_check, guard_counts, alias_resolution, scalar_functions, path_predicates, file_facts, watched_languages, analysis_summary,
)
QUERIES = {f.__name__: f for f in _ALL}
