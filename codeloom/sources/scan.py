"""Discovering and reading source trees."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never entered, extensions that are read, and configuration files looked for at the root.
SKIPPED_DIRS = (
    ".git", ".hg", ".svn", "dist", "build", "out", "target", "coverage", "node_modules", "bower_components", "vendor", ".yarn", ".cache", ".next", ".nuxt", ".turbo", ".angular", ".svelte-kit", ".vite",
    ".parcel-cache", ".astro", ".docusaurus", ".expo", ".vercel", ".serverless", ".output", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".terraform",
)
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "rs": "rust", "py": "python"}
CONFIG_FILES = (
    "tsconfig.json", "package.json", "jsconfig.json", "next.config.ts", "next.config.js", "next.config.mjs", "pnpm-workspace.yaml", "nx.json", "turbo.json", "Cargo.toml",
)
MOST_BYTES, MOST_DEPTH = 10_000_000, 20


def language_of(path: Column) -> Column:
    """The language by extension; null for others and for declaration files."""
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    out = F.lit(None).cast("string")
    for e, lang in LANGUAGES.items():
        out = F.when(ext == e, F.lit(lang)).otherwise(out)
    return F.when(path.endswith(".d.ts"), None).otherwise(out)


def is_skipped(path: Column) -> Column:
    """Whether a folder on the path is one that is never entered, or the path is too deep."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIPPED_DIRS])) | (F.size(dirs) >= MOST_DEPTH)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), length, content of every file but empty ones, which the file reader leaves out; filters on length and path prune before content is read."""
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return raw.select(F.expr(f"substring(path, locate({_quote(base)}, path) + {len(base)})").alias("path"), "length", "content")


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def discover_source_files(tree: DataFrame) -> DataFrame:
    """path, language of the source files of a tree (path)."""
    return tree.select("path", language_of(F.col("path")).alias("language")).where(F.col("language").isNotNull() & ~is_skipped(F.col("path")))


def discover_config_files(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("path").isin(*CONFIG_FILES)).select("path").distinct()


def read_sources(tree: DataFrame) -> DataFrame:
    """path, language, source: files of more than MOST_BYTES bytes and texts that are not UTF-8 are left out."""
    kept = tree.where(F.col("length") <= MOST_BYTES).withColumn("language", language_of(F.col("path"))).where(F.col("language").isNotNull() & ~is_skipped(F.col("path")))
    return kept.select("path", "language", F.expr("try_validate_utf8(cast(content as string))").alias("source")).where("source is not null")


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: ``*`` stays inside a segment; the parts around ``**`` are searched in order, the first one from anywhere."""
    parts = pattern.split("**")
    if len(parts) == 1:
        return "^" + "[^/]*".join(re.escape(p) for p in pattern.split("*")) + "$"
    body = "[\\s\\S]*?".join(re.escape(p) for p in parts if p)
    return body if pattern.endswith("**") else body + "$"


def filter_excluded(files: DataFrame, globs: list[str]) -> DataFrame:
    """The files that no glob matches; all globs are one expression, so nothing is joined."""
    for g in globs:
        files = files.where(~F.col("path").rlike(glob_regex(g)))
    return files
