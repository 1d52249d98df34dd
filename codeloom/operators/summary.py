"""Counts, health score and rankings over the issues of all categories.

The unified issue row: category, file, line, impact, confidence,
suggested_action, reason, files (all files it counts for). Categories that take
no part in rankings have a null impact, those that belong to no file no files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCORED = ("dead_code", "unused_exports", "unused_types", "gotchas", "circular_dependencies", "plugin_issues")
AT_RISK = ("dead_code", "unused_exports", "unused_types", "gotchas", "duplicate_code", "circular_dependencies")
RANKED_BY = ("dead_code", "unused_exports", "unused_types", "gotchas")
EMPTY_LINE, NO_IMPACT, NO_FILES = "cast(null as bigint)", "cast(null as double)", "cast(array() as array<string>)"

# category → (file, line, impact, confidence, suggested_action, reason, files) over the detector's columns
UNIFIED = {
    "dead_code": ("path", EMPTY_LINE, "cast(lines_of_code as double)", "confidence", "case when confidence >= 0.9 then 'safe-to-delete' else 'investigate' end", "reason", "array(path)"),
    "unused_exports": ("path", EMPTY_LINE, "1.0d", "0.8d", "'remove'", "concat('export ''', name, ''' is never imported')", "array(path)"),
    "unused_types": ("path", EMPTY_LINE, "1.0d", "0.8d", "'remove'", "concat(kind, ' ''', name, ''' is never imported')", "array(path)"),
    "duplicate_code": ("file_a", "start_a", "cast(end_a - start_a + 1 as double)", "confidence", "'investigate'", "concat('duplicates ', file_b, ' (L', start_b, '-L', end_b, ')')", "array(file_a, file_b)"),
    "gotchas": ("file", "line", "confidence", "confidence", "'investigate'", "concat(rule, ': ', message)", "array(file)"),
    "circular_dependencies": ("files[0]", EMPTY_LINE, "cast(size(files) as double)", "1.0d", "'investigate'", "concat('cycle: ', concat_ws(' → ', files))", "files"),
    "unused_dependencies": ("'package.json'", EMPTY_LINE, NO_IMPACT, "1.0d", "'remove'", "concat('package ''', package, ''' is listed but never imported')", NO_FILES),
    "unlisted_dependencies": ("path", EMPTY_LINE, NO_IMPACT, "1.0d", "'add'", "concat('package ''', package, ''' is imported but not listed')", "array(path)"),
    "unresolved_imports": ("source", EMPTY_LINE, NO_IMPACT, "1.0d", "'investigate'", "concat('import ''', spec, ''' is not resolved')", "array(source)"),
    "duplicate_exports": ("locations[0]", EMPTY_LINE, NO_IMPACT, "1.0d", "'investigate'", "concat('export ''', name, ''' stands in ', concat_ws(', ', locations))", NO_FILES),
    "plugin_issues": ("file", "line", NO_IMPACT, "confidence", "'investigate'", "concat(plugin, '/', rule, ': ', message)", NO_FILES),
}


def unified(issues: dict[str, DataFrame]) -> DataFrame:
    """All issues as unified rows."""
    out = None
    for category, df in issues.items():
        file, line, impact, confidence, action, reason, files = UNIFIED[category]
        part = df.select(
            F.lit(category).alias("category"), F.expr(file).alias("file"), F.expr(line).cast("bigint").alias("line"), F.expr(impact).cast("double").alias("impact"), F.expr(confidence).cast("double").alias("confidence"),
            F.expr(action).alias("suggested_action"), F.expr(reason).alias("reason"), F.expr(files).alias("files"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def top_issues(rows: DataFrame, most: int = 20, extra: list[str] | None = None) -> DataFrame:
    """The issues with the greatest impact, in a total order."""
    order = [F.desc("impact"), *[F.asc(c) for c in (extra or ["category", "file", "line", "reason"])]]
    return rows.where(F.col("impact").isNotNull() & ~F.isnan("impact")).orderBy(*order).limit(most)


def issues_per_file(rows: DataFrame) -> DataFrame:
    """file, issues over all categories; an issue counts for each of its ``files``, or for its ``file`` where rows have no such column or null in it."""
    files = F.coalesce("files", F.array("file")) if "files" in rows.columns else F.array("file")
    return rows.select(F.explode(files).alias("file")).where("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("issues"))


def files_at_risk(rows: DataFrame, most: int = 10) -> DataFrame:
    """Counts per file and category, the files with the most dead code, unused names and lint findings first."""
    if "files" in rows.columns:  # a cycle counts for all its files
        rows = rows.withColumn("file", F.explode(F.when((F.col("category") == "circular_dependencies") & F.col("files").isNotNull(), F.col("files")).otherwise(F.array("file"))))
    counts = rows.where("file is not null").groupBy("file").agg(*[F.count_if(F.col("category") == c).alias(c) for c in AT_RISK])
    return counts.orderBy(F.desc(sum((F.col(c) for c in RANKED_BY[1:]), F.col(RANKED_BY[0]))), "file").limit(most)


def top_risk_file(exports: DataFrame) -> DataFrame:
    """The file with the most unused exports."""
    return exports.groupBy("path").agg(F.count(F.lit(1)).alias("unused")).orderBy(F.desc("unused"), "path").limit(1)


def health_score(counts: DataFrame) -> DataFrame:
    """counts: total_files, total_issues, duplication_percentage → with health_score.

    100, less ten for each issue a file and 0.3 for each percent of
    duplication, within 0 and 100, to one decimal; no files count as no issues.
    """
    density = F.when(F.col("total_files") > 0, F.col("total_issues") / F.col("total_files")).otherwise(0.0)
    score = F.least(F.greatest(F.lit(100.0) - density * 10 - F.col("duplication_percentage") * 0.3, F.lit(0.0)), F.lit(100.0))
    return counts.withColumn("health_score", F.round(score * 10) / 10)


FAILING = ("dead_code", "unused_exports", "circular_dependencies", "gotchas", "unresolved_imports", "duplicate_exports")


def has_issues(issues: dict[str, DataFrame]) -> bool:
    """Whether any issue of a failing category is left; each category is probed for one row only."""
    return any(k in issues and not issues[k].isEmpty() for k in FAILING)


def summary(files: DataFrame, exports: DataFrame, issues: DataFrame, duplication: DataFrame) -> DataFrame:
    """One row: total_files, total_lines, total_exports, total_types, a count for each category, duplication_percentage, health_score.

    issues: category; duplication: one row with duplication_percentage.
    ``total_lines`` sums lines of code, ``total_types`` counts the unused types.
    All parts are one-row aggregates.
    """
    f = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("loc"), F.lit(0)).alias("total_lines"))
    e = exports.agg(F.count(F.lit(1)).alias("total_exports"))
    named = ("dead_code", "unused_exports", "unused_types", "duplicate_code", "gotchas", "circular_dependencies", "unused_dependencies", "duplicate_exports", "unresolved_imports", "unlisted_dependencies", "plugin_issues")
    i = issues.agg(*[F.count_if(F.col("category") == c).alias(c) for c in named])
    one = f.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(i)).crossJoin(F.broadcast(duplication.select("duplication_percentage")))
    scored = one.withColumn("total_types", F.col("unused_types")).withColumn("total_issues", sum((F.col(c) for c in SCORED[1:]), F.col(SCORED[0])))
    return health_score(scored).drop("total_issues")
