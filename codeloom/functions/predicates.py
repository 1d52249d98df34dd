"""Path and line predicates that decide where a detector applies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of lower-case paths that mark expected output, tests and tool files.
TEST_FIXTURE_PARTS = (
    "golden", ".snap.", ".expected.", ".baseline.", "__snapshots__", "__fixtures__", "__mocks__", ".test.", ".spec.", "/__tests__/", "/__test__/", "/tests/", "/examples/",
)
TEST_FIXTURE_ENDS = (
    ".snap", ".config.ts", ".config.js", ".config.mjs", "-types.ts", "-generated-schema.ts", "-generated-types.ts", "_test.rs", "/benches/",
)
EXAMPLE_DIRS = ("integration", "sample", "samples", "example", "examples", "demo", "demos")
# Names that frameworks expect in many files.
CONVENTIONAL_EXPORTS = (
    "GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "metadata", "generateMetadata", "dynamic", "revalidate", "dynamicParams", "default", "up", "down", "config",
)


def _any_part(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def is_test_fixture(path: Column) -> Column:
    low = F.lower(path)
    ends = F.lit(False)
    for e in TEST_FIXTURE_ENDS:
        ends = ends | low.endswith(e)
    return _any_part(low, TEST_FIXTURE_PARTS) | ends


def is_example_directory(path: Column) -> Column:
    return F.lower(path).rlike(rf"(^|/)({'|'.join(EXAMPLE_DIRS)})/")


def is_rust_lib_file(path: Column) -> Column:
    return path.rlike(r"(^|/)lib\.rs$")


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(tests|test|__tests__|fixtures)/|\.(test|spec)\.")


def is_example_or_script(path: Column) -> Column:
    return F.lower(path).rlike(r"/(examples|example|scripts|server|cli|bin|migrations|tools)/|gulpfile|gruntfile")


def is_comment_line(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*(//|\*|/\*)")


def within_root(path: Column) -> Column:
    """Whether a relative path never climbs above its root, by its segments alone; absolute paths are outside."""
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    depth = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda acc, s: F.struct(
            (acc["d"] + F.when(s == "..", -1).when((s == ".") | (s == ""), 0).otherwise(1)).alias("d"),
            F.least(acc["low"], acc["d"] + F.when(s == "..", -1).when((s == ".") | (s == ""), 0).otherwise(1)).alias("low"),
        ),
    )
    return ~path.startswith("/") & (depth["low"] >= 0)
