"""Snapshots of issues: differences, baselines, and the integrity of guarded files.

An issue row has category, key (its identity in a diff) and fingerprint (its
identity in a baseline); both are built here from the detectors' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import location
from codeloom.functions.text import guard_hash

NEVER_BASELINED = ("duplicate_code", "plugin_issue")

# The text form of an issue's identity: in a diff, and in a baseline.
DIFF_KEYS = {
    "dead_code": "path",
    "unused_export": "concat(path, '::', name)",
    "unused_type": "concat(path, '::', name)",
    "duplicate_code": "concat(file_a, ':L', start_a, '-', end_a, '::', file_b, ':L', start_b, '-', end_b)",
    "gotcha": "concat(file, ':', line, ':', rule)",
    "circular_dependency": "concat_ws('→', files)",
    "duplicate_export": "concat(name, '::', concat_ws(',', locations))",
    "unresolved_import": "concat(source, '::', spec)",
    "unused_dependency": "package",
    "unlisted_dependency": "concat(path, '::', package)",
}
BASELINE_KEYS = {
    "dead_code": "concat('dead_code::', path)",
    "unused_export": "concat('unused_export::', path, '::', name)",
    "duplicate_export": "concat('duplicate_export::', name, '::', concat_ws('|', locations))",
    "unused_type": "concat('unused_type::', path, '::', name)",
    "gotcha": "concat('gotcha::', file, '::', line, '::', rule)",
    "unused_dependency": "concat('unused_dep::', section, '::', package)",
    "circular_dependency": "concat('circular_dep::', concat_ws('->', files))",
    "unresolved_import": "concat('unresolved_import::', source, '::', spec)",
    "unlisted_dependency": "concat('unlisted_dep::', path, '::', package)",
}


def issue_keys(category: str, issues: DataFrame) -> DataFrame:
    """category, key, fingerprint (null where issues of the category are never baselined)."""
    prints = F.expr(BASELINE_KEYS[category]) if category in BASELINE_KEYS else F.lit(None).cast("string")
    return issues.select(F.lit(category).alias("category"), F.expr(DIFF_KEYS[category]).alias("key"), prints.alias("fingerprint"))


def all_keys(issues: dict[str, DataFrame]) -> DataFrame:
    out = None
    for category, df in issues.items():
        part = issue_keys(category, df)
        out = part if out is None else out.unionByName(part)
    return out


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """status (new, fixed, persisting), category, key; repeated issues stay repeated."""
    on = ["category", "key"]
    b, a = before.select(*on), after.select(*on)
    parts = (("new", a.join(b, on, "left_anti")), ("fixed", b.join(a, on, "left_anti")), ("persisting", a.join(b, on, "left_semi")))
    out = None
    for status, df in parts:
        part = df.select(F.lit(status).alias("status"), *on)
        out = part if out is None else out.unionByName(part)
    return out


def diff_net(changes: DataFrame) -> DataFrame:
    """category, new, fixed, net."""
    counts = changes.where("status <> 'persisting'").groupBy("category").agg(F.count_if(F.col("status") == "new").alias("new"), F.count_if(F.col("status") == "fixed").alias("fixed"))
    return counts.withColumn("net", F.col("new") - F.col("fixed"))


def make_baseline(keys: DataFrame) -> DataFrame:
    """fingerprint, distinct and in order."""
    return keys.where("fingerprint is not null").select("fingerprint").distinct().orderBy("fingerprint")


def apply_baseline(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """The issues whose fingerprint is not in the baseline; those without one stay."""
    return issues.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


CATEGORIES = {
    "dead_code": "dead_code", "unused_exports": "unused_export", "unused_types": "unused_type", "gotchas": "gotcha", "circular_dependencies": "circular_dependency", "unused_dependencies": "unused_dependency",
    "unlisted_dependencies": "unlisted_dependency", "unresolved_imports": "unresolved_import", "duplicate_exports": "duplicate_export", "duplicate_code": "duplicate_code",
}


def without_baselined(issues: dict[str, DataFrame], baseline: DataFrame) -> dict[str, DataFrame]:
    """The issues of each category whose fingerprint is not in the baseline; categories that are never baselined stay whole."""
    prints = baseline.select(F.col("fingerprint").alias("_print")).distinct()
    keyed = {k: BASELINE_KEYS.get(CATEGORIES.get(k, k)) for k in issues}
    return {k: df if keyed[k] is None else df.withColumn("_print", F.expr(keyed[k])).join(prints, "_print", "left_anti").drop("_print") for k, df in issues.items()}


def analysis_keys(issues: dict[str, DataFrame]) -> DataFrame:
    """category, key, fingerprint of all issues of an analysis; plug-in issues have no identity."""
    return all_keys({CATEGORIES[k]: df for k, df in issues.items() if k in CATEGORIES})


def suppressed(issues: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: how many issues the baseline removes."""
    return issues.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_semi").agg(F.count(F.lit(1)).alias("suppressed"))


def guard_add(manifest: DataFrame, files: DataFrame, description: Column | None = None) -> DataFrame:
    """The manifest with the given files added or renewed. files: path, source."""
    note = description if description is not None else F.lit(None).cast("string")
    fresh = files.where("source is not null").select(location(F.col("path")).alias("path"), guard_hash(F.col("source")).alias("hash"), note.alias("description")).dropDuplicates(["path"])
    return manifest.join(fresh.select("path"), "path", "left_anti").unionByName(fresh)


def guard_remove(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    return manifest.join(paths.select(location(F.col("path")).alias("path")).distinct(), "path", "left_anti")


def guard_update(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest with the hashes of the files that are in it renewed."""
    fresh = files.where("source is not null").select(location(F.col("path")).alias("path"), guard_hash(F.col("source")).alias("now")).dropDuplicates(["path"])
    return manifest.join(fresh, "path", "left").select("path", F.coalesce("now", "hash").alias("hash"), "description")


def guard_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, status (ok, mismatch, missing), expected, actual for every guarded file; unreadable files are missing."""
    now = files.select(location(F.col("path")).alias("path"), guard_hash(F.col("source")).alias("actual")).where("actual is not null").dropDuplicates(["path"])
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("hash"), "ok").otherwise("mismatch")
    return manifest.join(now, "path", "left").select("path", status.alias("status"), F.col("hash").alias("expected"), "actual")


def guard_summary(checked: DataFrame) -> DataFrame:
    """One row: passed, failed."""
    return checked.agg(F.count_if(F.col("status") == "ok").alias("passed"), F.count_if(F.col("status") != "ok").alias("failed"))
