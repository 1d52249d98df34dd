"""Relational detectors: unused, duplicate, unresolved and unlisted names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.predicates import CONVENTIONAL_EXPORTS, is_example_directory, is_rust_lib_file, is_test_fixture
from codeloom.functions.text import file_name, is_unresolved, text_lines, trim_all

USED_SECTIONS = ("dependencies", "devDependencies")
LISTED_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def unused_exports(exports: DataFrame, imported_names: DataFrame, entries: DataFrame | None = None, public_api: DataFrame | None = None, barrels: DataFrame | None = None) -> DataFrame:
    """path, name of the exports that nobody imports.

    An export is used if its (path, name) or (path, ``*``) is imported. Entry
    points, public API files, barrels, fixtures, examples and crate roots are
    left out. Repeated exports stay repeated; nulls never match.
    """
    kept = exports.select("path", "name").where(~is_test_fixture(F.col("path")) & ~is_example_directory(F.col("path")) & ~is_rust_lib_file(F.col("path")))
    for skip in (entries, public_api, barrels):
        if skip is not None:
            kept = kept.join(skip.select("path").distinct(), "path", "left_anti")
    names = imported_names.select(F.col("target").alias("path"), "name").distinct()
    return kept.join(names.where("name <> '*'"), ["path", "name"], "left_anti").join(names.where("name = '*'").select("path"), "path", "left_anti")


def unused_types(type_exports: DataFrame, names: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """path, name, kind of exported types whose name no import in any file mentions."""
    kept = type_exports.select("path", "name", "kind")
    if entries is not None:
        kept = kept.join(entries.select("path").distinct(), "path", "left_anti")
    return kept.join(names.select("name").distinct(), "name", "left_anti").select("path", "name", "kind")


def expand_star_types(type_exports: DataFrame, stars: DataFrame) -> DataFrame:
    """Type exports with those that ``export *`` copies to a barrel, over exactly one hop. stars: barrel, target."""
    copied = stars.select("barrel", F.col("target").alias("path")).distinct().join(type_exports, "path").select(F.col("barrel").alias("path"), "name", "kind")
    return type_exports.select("path", "name", "kind").unionByName(copied)


def unused_dependencies(manifest: DataFrame, external_imports: DataFrame) -> DataFrame:
    """package, section of dependencies and devDependencies that no file imports."""
    declared = manifest.where(F.col("section").isin(*USED_SECTIONS)).select("package", "section").distinct()
    return declared.join(external_imports.select("package").distinct(), "package", "left_anti").select("package", "section")


def unlisted_dependencies(external_imports: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, package of the imports that no section of the manifest lists."""
    listed = manifest.where(F.col("section").isin(*LISTED_SECTIONS)).select("package").distinct()
    return external_imports.select("path", "package").where("package <> ''").distinct().join(listed, "package", "left_anti").select("path", "package")


def unresolved_imports(edges: DataFrame) -> DataFrame:
    """source, spec of the edges whose target is still a specifier."""
    return edges.where(is_unresolved(F.col("target"))).select("source", F.col("target").alias("spec")).distinct()


def duplicate_exports(exports: DataFrame) -> DataFrame:
    """name, locations of names exported more than once; names that frameworks expect everywhere are left out."""
    return (
        exports.where(~F.col("name").isin(*CONVENTIONAL_EXPORTS)).groupBy("name")
        .agg(F.sort_array(F.collect_list("path")).alias("locations")).where(F.size("locations") > 1)
    )


def barrel_files(files: DataFrame) -> DataFrame:
    """path of the files that mostly re-export.

    A barrel has re-exports only, or is an index file with more than 60 %
    re-export statements, or has at least three and more than 30 %. An export
    block that spans lines is one statement.
    """
    flat = F.regexp_replace(F.col("source"), r"(?s)export\s+(type\s+)?\{[^}]*\}(\s*from\s+['\"][^'\"]*['\"])?\s*;?", "export {}$2;")
    lines = F.filter(F.transform(text_lines(flat), trim_all), lambda x: ~x.rlike(r"^(//|/\*|\*|$)"))
    # lambdas, so that the lines are made and counted once for each text
    counts = F.transform(F.array(lines), lambda x: F.struct(F.size(F.filter(x, lambda y: y.rlike(r"^export \*|^export\b.*\sfrom\s"))).alias("again"), F.size(x).alias("all")))
    index = file_name(F.col("path")).rlike(r"^index\.(ts|tsx|js|jsx)$")

    def barrel(n):
        ratio = n["again"] / F.greatest(n["all"], F.lit(1))
        return (n["all"] > 0) & (((ratio >= 1.0) & (n["again"] >= 1)) | (index & (ratio > 0.6)) | (~index & (ratio > 0.3) & (n["again"] >= 3)))

    return files.where(F.col("source").contains("export")).where(F.exists(counts, barrel)).select("path").distinct()


def at_least(issues: DataFrame, confidence: float) -> DataFrame:
    """Issues with the confidence or more; categories without a confidence stay."""
    return issues.where(F.col("confidence").isNull() | (F.col("confidence") >= confidence))


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_of_each(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
