"""Queries over tables with source texts that break off anywhere."""

import pytest

from codeloom.functions.rust_facts import rust_facts
from codeloom.functions.script_facts import script_facts
from codeloom.operators import clones, lint
from codeloom.plans import core_queries, sample_queries

GOOD = 'import { x } from "./b";\nimport pkg from "left-pad";\nexport const y = 1;\nexport interface Shape { a: number }\nexport function f(a: number) {\n  if (a) {\n    return x;\n  }\n  return a;\n}\n'
BROKEN = ["export const z = 1;\ntry {\n  z();\n} catch (e", "if", "try { a } catch", "while (a) switch", "catch", "for await", "import * as", "export * as", "if (a) b();\n" + "else if (c) d();\n" * 1100]


@pytest.fixture(scope="module")
def broken(spark, tmp_path_factory):
    """A folder with tables of two whole files and a broken one for each way to break off."""
    d = str(tmp_path_factory.mktemp("broken"))
    texts = [("good.ts", GOOD), ("b.ts", "export const x = 1;\nexport const y = 2;\n")] + [(f"broken{i}.ts", t) for i, t in enumerate(BROKEN)]
    rows = spark.createDataFrame([(p, "typescript", t) for p, t in texts], "path string, language string, source string")
    rows.selectExpr("*", "0L as functions", "0L as classes", "timestamp'2025-01-01 00:00:00' as loaded_at").write.parquet(f"{d}/files.parquet")
    spark.createDataFrame([("good.ts", 5, 10)], "path string, start_line bigint, end_line bigint").write.parquet(f"{d}/blocks.parquet")
    return d


@pytest.mark.parametrize("text", BROKEN)
def test_scripts_that_break_off(text):
    for language in ("typescript", "tsx", "javascript", "jsx"):
        for i in range(len(text) + 1) if len(text) < 100 else (len(text),):
            script_facts(text[:i], language)


def test_rust_that_breaks_off():
    assert rust_facts("use self;\npub static mut") == ([], [], [], 0)


def test_file_facts(spark, broken):
    facts = {r.path: r for r in core_queries.file_facts(spark, broken).collect()}
    assert len(facts) == 2 + len(BROKEN)
    assert (facts["broken0.ts"].exports, facts["broken0.ts"].max_nesting_depth, facts[f"broken{len(BROKEN) - 1}.ts"].max_nesting_depth) == (1, 1, 1101)


def test_exported_names(spark, rows, broken):
    assert rows(core_queries.exported_names(spark, broken)) == [("b.ts", "x"), ("b.ts", "y"), ("broken0.ts", "z"), ("good.ts", "Shape"), ("good.ts", "f"), ("good.ts", "y")]


def test_external_packages(spark, rows, broken):
    assert rows(core_queries.external_packages(spark, broken)) == [("good.ts", "left-pad")]


def test_unused_types(spark, rows, broken):
    assert rows(core_queries.unused_types(spark, broken)) == [("good.ts", "Shape", "interface")]


def test_duplicate_exports(spark, rows, broken):
    assert rows(core_queries.duplicate_exports(spark, broken)) == [("y", "b.ts,good.ts")]


def test_blocks_found(spark, rows, broken):
    assert rows(core_queries.blocks_found(spark, broken)) == [("good.ts", 5, 10)]


def test_unresolved_imports(spark, rows, broken):
    assert rows(core_queries.unresolved_imports(spark, broken)) == []


def test_function_counts(spark, rows, broken):
    assert ("good.ts", 1) in [r[:2] for r in rows(sample_queries.function_counts(spark, broken))]


def test_watched_languages(spark, rows, broken):
    assert rows(core_queries.watched_languages(spark, broken)) == [("typescript", 2 + len(BROKEN))]


def test_analysis_summary(spark, broken):
    r = core_queries.analysis_summary(spark, broken).collect()
    assert len(r) == 1 and r[0].total_files == 2 + len(BROKEN)


TYPED_JS = 'export interface Shape { a: number }\nexport type Side = "l" | "r";\nexport type { Shape };\nexport const type = 1;\nconst interface_ = type;\n'
OPEN_QUOTE = 'pub fn first() {\n  let a = "open;\n  go("x");\n}\n\npub fn second() {\n  go("y \\\n  z");\n}\npub fn third() {\n  go("z", \'"\');\n}\n'


def tables(spark, d, texts):
    spark.createDataFrame(texts, "path string, language string, source string").selectExpr("*", "timestamp'2025-01-01 00:00:00' as loaded_at").write.parquet(f"{d}/files.parquet")
    return str(d)


def test_exported_names_of_types_in_plain_scripts_and_after_open_quotes(spark, rows, tmp_path):
    d = tables(spark, tmp_path, [("a.js", "javascript", TYPED_JS), ("b.jsx", "jsx", "export interface Props { a: 1 }\n"), ("c.rs", "rust", OPEN_QUOTE)])
    assert rows(core_queries.exported_names(spark, d)) == [("a.js", "Shape"), ("a.js", "Side"), ("a.js", "type"), ("b.jsx", "Props"), ("c.rs", "first"), ("c.rs", "second"), ("c.rs", "third")]


def test_rust_strings_over_lines_stay_whole():
    whole = 'pub fn a() { go("text\npub fn b() {}\n"); }\npub fn c() {}\n'
    assert rust_facts(whole)[0] == ["a", "c"]


def test_unused_types_of_plain_scripts(spark, rows, tmp_path):
    d = tables(spark, tmp_path, [("a.js", "javascript", TYPED_JS), ("b.jsx", "jsx", "import type { Side } from './a';\nexport interface Props { a: 1 }\n")])
    assert rows(core_queries.unused_types(spark, d)) == [("a.js", "Shape", "interface"), ("b.jsx", "Props", "interface")]


def test_analysis_summary_takes_one_text_of_a_path_in_every_use_and_writes_it_once(spark, rows, tmp_path, monkeypatch):
    d = tables(spark, tmp_path, [("a.ts", "typescript", "const b = 1;\n"), ("a.ts", "typescript", "const a = 1;\n"), ("a.ts", "typescript", "const a = 1;\n"), ("c.rs", "rust", "fn c() {}\n"), ("c.rs", None, "fn c() {}\n"), ("n.ts", "typescript", None)])
    seen, whole = [], core_queries.analyze
    monkeypatch.setattr(core_queries, "analyze", lambda files: seen.append(files) or whole(files))
    assert core_queries.analysis_summary(spark, d).collect()[0].total_files == 2
    assert rows(seen[0]) == [("a.ts", "typescript", "const a = 1;\n"), ("c.rs", None, "fn c() {}\n")]
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_fragments_of_a_path_with_several_texts_are_distinct_without_a_shuffle(spark, rows):
    text = "".join(f"let value{i} = compute{i}(input{i}, {i});\n" for i in range(12))
    files = spark.createDataFrame([("a.ts", text), ("a.ts", text + "let more = 1;\n"), ("a.ts", text), ("b.ts", text)], "path string, source string")
    shared = clones.shared_fragments(files)
    assert len(rows(shared)) == len(set(map(str, rows(shared)))) and set(map(str, rows(shared))) >= set(map(str, rows(clones.fragments(files.where("path = 'b.ts'")))))
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_line_rules_see_macros_around_string_literals(spark, rows):
    files = spark.createDataFrame([("a.rs", "rust", 'pan""ic!("y");\nlet s = "todo!(";\n"a" dbg!(1);\n')], "path string, language string, source string")
    assert [r[1:3] for r in rows(lint.line_issues(files).select("file", "line", "rule"))] == [(1, "rust-panic"), (3, "rust-dbg")]
