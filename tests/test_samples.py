"""The sample project gives the rows expected of it, and hooks keep their limits."""

import time

import pytest

from codeloom.operators import facts, resolve
from codeloom.operators.prefix import prefix_join
from codeloom.plans import fix, sample_queries
from codeloom.plans.sample_rows import EXPECTED
from codeloom.registry import Plugin, Registry

QUICK = ("sample_facts", "sample_metrics", "block_findings", "rust_imports", "scoped_resolution", "config_aliases", "declared_entries", "public_files", "crate_targets", "scanned_tree", "issue_identities", "reexport_chains", "sarif_rows", "plugin_results", "bracket_errors")


@pytest.mark.parametrize("name", QUICK)
def test_expected_rows(spark, name):
    schema, rows = EXPECTED[name]
    got = sample_queries.QUERIES[name](spark, "")
    assert ", ".join(f"{c} {t}" for c, t in got.dtypes) == schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_slow_and_large_calls(spark):
    registry = Registry(seconds=0.2)
    registry.add(Plugin("slow")).hook("analyze_file")(lambda path, source, language: time.sleep(5) if path == "s.ts" else [{"rule": "seen"}])
    rows = [("s.ts", "typescript", "x"), ("a.ts", "typescript", "x"), ("big.ts", "typescript", "x" * 10_000_001)]
    got = {(r.file, r.rule) for r in registry.file_issues(spark.createDataFrame(rows, "path string, language string, source string")).collect()}
    assert got == {("s.ts", "plugin-error"), ("a.ts", "seen")}


def test_readers_of_other_languages(spark):
    files = spark.createDataFrame([("a.lua", "lua", "return 1\n"), ("b.lua", None, "x")], "path string, language string, source string")
    got = facts.parse_files(files, {"lua": lambda language, source: {"exports": ["made"], "functions": 2}})
    assert {(r.path, tuple(r.exports), r.functions) for r in got.collect()} == {("a.lua", ("made",), 2), ("b.lua", (), 0)}


def test_edited_sources_are_written(spark, tmp_path):
    edited = spark.createDataFrame([("src/a.ts", "const a = 1;\n"), ("b.ts", "")], "path string, source string")
    assert fix.write_sources(edited, f"file://{tmp_path}/") == 2
    assert (tmp_path / "src/a.ts").read_text() == "const a = 1;\n" and (tmp_path / "b.ts").read_text() == ""


def test_prefix_join(spark):
    rows = spark.createDataFrame([("abc",), ("ab",), ("b",), ("",), (None,)], "t string")
    known = spark.createDataFrame([("a", 1), ("ab", 2), ("", 3), ("abcd", 4), (None, 5)], "p string, n int")
    assert {(r.t, r.n) for r in prefix_join(rows, "t", known, "p").collect()} == {("abc", 1), ("abc", 2), ("abc", 3), ("ab", 1), ("ab", 2), ("ab", 3), ("b", 3), ("", 3)}
    assert {r.t for r in prefix_join(rows, "t", known.where("n < 3"), "p", "left_semi").collect()} == {"abc", "ab"}
    assert prefix_join(rows, "t", known.limit(0), "p").count() == 0


def test_crate_children_of_each_root(spark):
    files = spark.createDataFrame([(p,) for p in ("lib.rs", "one.rs", "two/mod.rs", "two/lib.rs", "three/lib.rs", "four/x.rs", "c/src/main.rs", "c/src/m.rs")], "path string")
    got = {tuple(r) for r in resolve.crate_children(files).collect()}
    assert ("lib.rs", "mod::one", "one.rs") in got and ("lib.rs", "mod::two", "two/mod.rs") in got and ("c/src/main.rs", "mod::m", "c/src/m.rs") in got and not any(x[2] == "four/x.rs" for x in got)
