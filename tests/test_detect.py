from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions.paths import location
from codeloom.functions.predicates import within_root
from codeloom.operators import detect, state, summary
from codeloom.operators.resolve import resolve_imports, resolve_rust

PN = "path string, name string"
NAMES = "target string, name string"


def test_unused_exports(spark, rows):
    exports = spark.createDataFrame([("utils.ts", n) for n in ("foo", "bar", "baz")] + [("entry.ts", "x"), ("api.ts", "y"), ("index.ts", "z"), ("a.test.ts", "t"), ("examples/e.ts", "u"), ("src/lib.rs", "v"), ("glob.rs", "w")], PN)
    imported = spark.createDataFrame([("utils.ts", "foo"), ("glob.rs", "*"), (None, "bar")], NAMES)
    one = lambda p: spark.createDataFrame([(p,)], "path string")
    got = detect.unused_exports(exports, imported, one("entry.ts"), one("api.ts"), one("index.ts"))
    assert rows(got) == [("utils.ts", "bar"), ("utils.ts", "baz")]


def test_types_deps_and_duplicates(spark, rows):
    types = spark.createDataFrame([("a.ts", "Config", "type"), ("a.ts", "Result", "type")], "path string, name string, kind string")
    assert rows(detect.unused_types(types, spark.createDataFrame([("Config",)], "name string"))) == [("a.ts", "Result", "type")]
    stars = spark.createDataFrame([("barrel.ts", "a.ts")], "barrel string, target string")
    assert detect.expand_star_types(types, stars).count() == 4
    manifest = spark.createDataFrame([("package.json", "dependencies", "react"), ("package.json", "devDependencies", "jest"), ("package.json", "peerDependencies", "vue")], "package_json string, section string, package string")
    imports = spark.createDataFrame([("src/app.ts", "react"), ("src/app.ts", "vue"), ("src/app.ts", "left-pad"), ("src/b.ts", "")], "path string, package string")
    assert rows(detect.unused_dependencies(manifest, imports)) == [("jest", "devDependencies")]
    assert rows(detect.unlisted_dependencies(imports, manifest)) == [("src/app.ts", "left-pad")]
    exports = spark.createDataFrame([("a", "foo"), ("a", "bar"), ("b", "foo"), ("c", "baz"), ("a", "GET"), ("b", "GET")], PN)
    assert rows(detect.duplicate_exports(exports)) == [("foo", ("a", "b"))]
    edges = spark.createDataFrame([("x", "./broken"), ("x", "../helpers"), ("x", "lodash"), ("x", "src/utils.ts")], "source string, target string")
    assert rows(detect.unresolved_imports(edges)) == [("x", "../helpers"), ("x", "./broken")]


def test_barrels(spark, rows):
    files = [("index.ts", "typescript", "export * from './a';\nexport {\n  b,\n  c\n} from './b';\nconst x = 1;\n"), ("a.ts", "typescript", "export const a = 1;\n"), ("icons.ts", "typescript", "export { default } from './i'\n"), ("e.ts", "typescript", ""), ("n.ts", "typescript", None)]
    assert rows(detect.barrel_files(spark.createDataFrame(files, "path string, language string, source string"))) == [("icons.ts",), ("index.ts",)]


def test_resolution(spark, rows):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/lib/index.ts", "src/app.component.ts", "pkg/src/x.tsx", "src/b.js", "root.ts")], "path string")
    ask = [("src/main.ts", "./a"), ("src/main.ts", "./lib"), ("src/main.ts", "./app.component"), ("src/main.ts", "./a.js"), ("src/main.ts", "../../up"), ("src/main.ts", "@/b"), ("pkg/src/m.ts", "@/x"), ("src/main.ts", "src/a"), ("src/main.ts", "./none"), ("main.ts", "./root"), (None, "x")]
    aliases = spark.createDataFrame([(None, 0, "@/", "src/"), ("pkg", 0, "@/", "pkg/src/")], "scope_dir string, ord int, prefix string, target string")
    got = {(r.importer, r.spec): r.target for r in resolve_imports(spark.createDataFrame(ask, "importer string, spec string"), files, aliases).collect()}
    assert got == {
        ("src/main.ts", "./a"): "src/a.ts", ("src/main.ts", "./lib"): "src/lib/index.ts", ("src/main.ts", "./app.component"): "src/app.component.ts", ("src/main.ts", "./a.js"): "src/a.ts", ("src/main.ts", "../../up"): None,
        ("src/main.ts", "@/b"): "src/b.js", ("pkg/src/m.ts", "@/x"): "pkg/src/x.tsx", ("src/main.ts", "src/a"): "src/a.ts", ("src/main.ts", "./none"): None, ("main.ts", "./root"): "root.ts",
    }
    crates = spark.createDataFrame([(p,) for p in ("src/main.rs", "src/parse.rs", "src/io/mod.rs")], "path string")
    uses = spark.createDataFrame([("src/main.rs", "crate::parse::Tree"), ("src/main.rs", "self::io"), ("src/io/mod.rs", "super::parse"), ("src/main.rs", "serde::Serialize")], "importer string, module string")
    assert {r.module: r.target for r in resolve_rust(uses, crates).collect()} == {"crate::parse::Tree": "src/parse.rs", "self::io": "src/io/mod.rs", "super::parse": "src/parse.rs", "serde::Serialize": None}


def test_text_functions(spark):
    one = lambda col, value, kind="string": spark.createDataFrame([(value,)], f"v {kind}").select(col(F.col("v"))).first()[0]
    assert one(tx.text_lines, "a\r\nb\n") == ["a", "b"] and one(tx.text_lines, "") == [] and one(tx.text_lines, "a\n\n") == ["a", ""]
    assert one(lambda c: tx.count_loc(c)[0], "x\n\t// c\n \ny /* z */\n") == 2
    assert one(tx.normalized, "A // b\n/* c */ BÉ") == "a bÉ"
    assert one(tx.package_name, "@s/n/x") == "@s/n" and one(tx.package_name, "a/b") == "a" and one(tx.package_name, "@") == ""
    assert one(tx.unquote, "'a'") == "a" and one(tx.unquote, "'a\"") == "'a\""
    assert one(tx.pattern_tokens, "const [user, setUser] = useState<User>();") == ["const", "[", "user", ",", "setUser", "]", "=", "useState", "<", "User", ">", "(", ")", ";"]
    assert one(tx.pattern_tokens, "vec![1]; a::b != 'x y'") == ["vec!", "[", "1", "]", ";", "a", "::", "b", "!=", "'x y'"]
    assert one(lambda c: tx.truncate_bytes(c, 6, 4), "éééé") == "éé..." and one(lambda c: tx.truncate_bytes(c, 6, 4), "abc") == "abc"
    assert one(tx.common_prefix_dir, ["src/a/x.ts", "src/a/y.ts", "src/b.ts"], "array<string>") == "src/" and one(tx.common_prefix_dir, ["a.ts"], "array<string>") == ""
    assert one(tx.strip_ansi, "\x1b[31mred\x1b[0m") == "red" and one(tx.shell_quote, "it's") == "'it'\\''s'"
    assert one(location, "./a//b/../c\\d") == "a/c/d" and one(location, "../x") == "x" and one(location, None) is None
    assert one(within_root, "a/../../b") is False and one(within_root, "a/../b") is True and one(within_root, "/b") is False
    pair = spark.createDataFrame([([1, 2, 3, 4], [3, 4, 5, 6])], "a array<int>, b array<int>")
    assert abs(pair.select(tx.jaccard(F.col("a"), F.col("b"))).first()[0] - 1 / 3) < 1e-9


def test_state(spark, rows):
    key = "category string, key string"
    before = spark.createDataFrame([("dead_code", "a"), ("dead_code", "b")], key)
    after = spark.createDataFrame([("dead_code", "b"), ("dead_code", "c"), ("dead_code", "c")], key)
    changes = state.diff(before, after)
    assert rows(changes) == [("fixed", "dead_code", "a"), ("new", "dead_code", "c"), ("new", "dead_code", "c"), ("persisting", "dead_code", "b")]
    assert rows(state.diff_net(changes)) == [("dead_code", 2, 1, 1)]
    keyed = state.all_keys({"dead_code": spark.createDataFrame([("a",)], "path string"), "duplicate_export": spark.createDataFrame([("n", ["a", "b"])], "name string, locations array<string>")})
    assert rows(keyed) == [("dead_code", "a", "dead_code::a"), ("duplicate_export", "n::a,b", "duplicate_export::n::a|b")]
    base = state.make_baseline(keyed.where("category = 'dead_code'"))
    assert state.apply_baseline(keyed, base).count() == 1 and state.suppressed(keyed, base).first()[0] == 1
    files = spark.createDataFrame([("a.ts", "x"), ("./b.ts", "y"), ("n.ts", None)], "path string, source string")
    manifest = state.guard_add(spark.createDataFrame([], "path string, hash string, description string"), files)
    now = spark.createDataFrame([("a.ts", "x"), ("b.ts", "changed")], "path string, source string")
    assert [(r.path, r.status) for r in state.guard_check(manifest, now).orderBy("path").collect()] == [("a.ts", "ok"), ("b.ts", "mismatch")]
    assert state.guard_summary(state.guard_check(manifest, now.where("path = 'a.ts'"))).first() == (1, 1)
    assert {r.status for r in state.guard_check(state.guard_update(manifest, now), now).collect()} == {"ok"}
    assert state.guard_remove(manifest, spark.createDataFrame([("./a.ts",)], "path string")).count() == 1


def test_health_score(spark):
    score = lambda f, i, d: summary.health_score(spark.createDataFrame([(f, i, d)], "total_files bigint, total_issues bigint, duplication_percentage double")).first()["health_score"]
    assert score(1, 0, 5.0) == 98.5 and score(0, 7, 0.0) == 100.0 and score(1, 50, 0.0) == 0.0
