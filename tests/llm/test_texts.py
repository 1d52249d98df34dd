"""Syntax, hand-written source, leakage, mixing and truncation."""

import ast
import random
import tracemalloc

import numpy as np
import pytest

from codeloom.llm import handwritten, truncation
from codeloom.llm.leak import leaked_items, leaked_passages, shard_hits, without_leaks, words
from codeloom.llm.lr import Recognizer, Tables, read_grammar
from codeloom.llm.mixing import flight, land, mix
from codeloom.llm.syntax import check_files, error_rates, first_error, invalid_files
from codeloom.operators.pairs import bucket_cross

VALID = {
    "javascript": ["", "#!/usr/bin/env node\nconst a = 1, b = /x[/]y/g.test(s)\nlet c = a\n++b\n", "for (const x of xs) if (x) { y?.z?.(1) } else do { q() } while (w)\n", "x = (a, b) => ({ a, b: [...c], get d() { return 1 }, async *e() {} })\n", "label: for (;;) { break label }\nclass A extends B { #p = 1; static { f() } get x() { return this.#p } }\n", "const t = `a${b ? `c${d}` : ''}e`\nimport x, { default as y } from 'm'\nexport * as ns from 'q'\nexport default class {}\n", "return_ = async x => await x\nif (a) b\nelse c\n"],
    "typescript": ["type A<T extends keyof B = never> = T extends infer U ? { readonly [K in keyof U]?: U[K] } : string[]\n", "abstract class C<T> implements I<T> { constructor(private readonly a: number, b?: string) { super() } abstract m(): void; x!: number }\n", "function f(this: Window, x: unknown): asserts x is string\nfunction f(x: any) { return <string>x as const }\n", "const g = async <T,>(a: Map<string, Array<T>>): Promise<void> => { a satisfies object }\nenum E { A = 1, 'b' }\ndeclare module 'm' { export const z: typeof import('q') }\n"],
    "tsx": ["const a = <T,>(x: T) => x\nexport const B = () => <div a=\"1\" {...p}>it's {x ? <b/> : null}<></></div>\n"],
    "jsx": ["const a = b < c\nconst v = <A.B c={<d/>}>text & 'quote {1}</A.B>\n"],
    "python": ["", "def f(a, /, b=1, *args, c: int = 2, **k) -> None:\n    return [x async for x in y if x]\n", "match x:\n    case {'a': [1, *rest], **kw} if q: pass\n    case A(b=c) | None as d:\n        pass\n", "with (open(a) as f, g() as h): pass\ntry:\n\tx = '''a\n'''\nexcept* E as e:\n\traise\n", "print(f'{a!r:>{w}}', *b, **c)\nlambda *a, b=1: (yield)\n@d\nasync def q(): await z\n"],
    "rust": ["", "fn main() -> Result<(), Box<dyn Error>> { let x: Vec<Vec<u8>> = vec![1, 2]; if let Some(y) = x.get(0) { y? } else { return Ok(()) }; Ok(()) }\n", "impl<'a, T: 'a + ?Sized> Tr for &'a T where T: Fn(u8) -> u8 { const N: usize = 3; type O = [u8; 4]; fn f(&mut self, r#type: char) -> impl Iterator<Item = u8> + '_ { 'l: loop { break 'l } } }\n", "macro_rules! m { ($x:expr) => { $x } }\n/* a /* b */ c */\nstatic S: &str = r##\"a\"#b\"##;\nmatch_me!{ } mod q;\n", "pub(crate) enum E { A { x: i32 }, B(u8), C = 3 }\nfn g() { match x { 1..=2 | 5 => {} E::A { x, .. } if x > 1 => 3, _ => unreachable!() } ; |a: u8| -> u8 { a }; S { ..d } }\n"],
}
BROKEN = {
    "javascript": ["const x\n", "function f() {\n", "let s = 'a\n", "f(a,, b)\n", "<<<<<<< HEAD\n", "cosnt x = 1\n", "let a: string = 1\n", "const v = <div/>\n", "}\n", "if (a {\n}\n", "use crate::a::B;\n", "\ufffd\ufffd x\n", "`abc\n", "/* open\n", "a + b = c\n"],
    "typescript": ["type A = \n", "interface X { a: }\n", "const v = <div>a</div>\n", "fucntion f() {}\n", "import { a from 'b'\n"],
    "tsx": ["const a = <div><span></div>\nfoo(\n", "const b = <a>{</a>\n"],
    "jsx": ["const a = <div>\n"],
    "python": ["def f(:\n    pass\n", "if x:\npass\n", "  x = 1\n", "x = (1\n", "s = 'a\n", "def f():\n    a\n  b\n", "dfe f():\n    pass\n", "print 'a'\n", "x = 5 5\n", "const x = 1;\n"],
    "rust": ["fn main() {\n", "fn f( { }\n", "let x = 1;\n", "fn f() { let s = \"a; }\n", "strcut A;\n", "fn f() { x y }\n", "<<<<<<< ours\n", "def f():\n  pass\n"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid_and_broken_sources(language):
    for source in VALID[language]:
        assert first_error(language, source) is None, source
        assert first_error(language, "\ufeff" + source.replace("\n", "\r\n")) is None, source
    for source in BROKEN[language]:
        assert first_error(language, source) is not None, source


def test_python_agrees_with_the_compiler():
    rng = random.Random(1)
    good = "\n".join(VALID["python"])
    for _ in range(150):
        lines = good.split("\n")
        i = rng.randrange(len(lines))
        cut = rng.randrange(len(lines[i]) + 1)
        lines[i] = rng.choice([lines[i][:cut], lines[i][cut:], lines[i] + " )", " " + lines[i]])
        text = "\n".join(lines)
        try:
            ast.parse(text)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if ok != (first_error("python", text) is None):
            assert not ok and "yield" in text or "rest" in text or "*" in text, text  # rules beyond the grammar


def test_what_a_chunk_did_is_remembered_exactly():
    start, rules = read_grammar("S: St*\nSt: E ';' | '{' St* '}'\nE: 'n' | E '+' E | '(' E % ',' ')' | '(' P % ',' ')' '>' E\nP: 'n' (':' 'n')?", set())
    tables, rng = Tables(start, rules), random.Random(6)
    kept = Recognizer(tables)
    for _ in range(400):
        text = [rng.choice("nn+(),>:;{}") for _ in range(rng.randrange(1, 9))]
        fresh = Recognizer(tables)
        whole = fresh.feed(fresh.start(), tuple(text))
        stacks, at = kept.start(), 0
        for i in range(0, len(text), 3):
            stacks, bad = kept.feed(stacks, tuple(text[i : i + 3]))
            if bad >= 0:
                break
        assert bool(whole[0]) == bool(stacks)
        if stacks:
            assert fresh.finish(whole[0]) == kept.finish(stacks)


def test_files_table(spark):
    rows = [("r/a.ts", "r", "typescript", "const a: number = 1\n"), ("r/b.py", "r", "python", "x = (\n"), ("r/b.py", "r", "python", "x = (\n"), ("r/c.ts", "r", "typescript", None), ("r/d.xx", "r", "cobol", "?"), (None, "r", "rust", "?"), ("q/e.js", None, "JavaScript ", ""), ("q/f.js", "q", "javascript", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 9, "z") for r in rows], "path string, repo string, language string, source string, line int, token string")
    assert {r.path for r in invalid_files(df).collect()} == {"r/b.py"}
    assert check_files(df).count() == 4
    assert {(r.repo, r.language): r.rate for r in error_rates(df).collect()}[("r", "python")] == 1.0
    assert check_files(df.limit(0)).count() == 0


def test_classes_of_source():
    c = handwritten.classify
    assert c("a/x.ts", "// words\n// @generated by tool 1.2\n\nexport const a = 1;\n") == "generated"
    assert c("a/x.ts", "// Code generated by toolc. DO NOT EDIT.\nconst a = 1;\n") == "generated"
    assert c("a/x.ts", "// Writes the generated tables; do not edit the output of f, edit this file.\nconst a = 1;\n") is None
    assert c("a/x.ts", 'const s = "// @generated by tool, DO NOT EDIT";\n') is None
    assert c("a/x.py", "# hand-kept list, was generated once, is edited here now\na = 1\n") is None
    assert c("a/vendor/x.js", "let a\n") == "vendored" and c("a/vendor-portal/x.js", "let a\n") is None and c("a/vendors/x.js", "let a\n") is None
    assert c("a/x.js", "/*! lib v1.2.3 | (c) lib contributors | MIT */\nlet a\n") == "vendored"
    assert c("a/x.js", "/* Portions follow the idea of lib, rewritten here. License: see the root folder. */\nlet a\n") is None
    assert c("a/x.min.js", "let a\n") == "minified"
    assert c("a/x.js", "var a=function(b){return b.c&&d(b)||!1};" * 40) == "minified"
    assert c("a/x.js", 'const a = "' + "long words here " * 60 + '";\nexport function f() {\n  return a;\n}\n') is None
    assert c("a/x.ts", "export const A = [\n" + "  12, 34, 56, 78,\n" * 60 + "];\n") == "data"
    assert c("a/x.ts", "const t = [1, 2, 3];\n" + "export function f(a) {\n  return t[a];\n}\n" * 20) is None
    assert c("a/x.ts", "".join(f'reg.define("N.F{i}.{i}", {{ id: {700 + i} }});\n' for i in range(30))) == "generated"
    assert c("a/x.ts", "") is None
    assert c("a/x.ts", "// Code generated by protoc. The text below is machine output.\nconst a = 1;\n") == "generated"
    assert c("a/x.ts", "// This file was once automatically generated by toolc, now it is kept here\nconst a = 1;\n") is None
    assert c("a/x.ts", '// Writes "Code generated by toolc" on top of each file\nconst a = 1;\n') is None
    assert c("a/x.ts", "// Not a draft.\n// Code generated by toolc\nconst a = 1;\n") == "generated"
    assert c("a/x.ts", "// words\n" * 200 + "// @generated by tool\nconst a = 1;\n") == "generated"


def test_long_headers_are_read_to_the_code():
    licence = "/*\n" + " * Permission is hereby granted, free of charge, to any person.\n" * 40 + " */\n"
    wrapper = "(function (root, factory) {\n  module.exports = factory();\n}(this, function () {}));\n"
    c = handwritten.classify
    assert c("a/x.js", licence + "'use strict';\n" + wrapper) == "vendored" and c("a/x.js", licence.replace("\n */", " */ ").rstrip("\n") + wrapper) == "vendored"
    assert c("a/x.js", licence + "// @generated by tool\nlet a\n") == "generated" and c("a/x.js", licence.replace(" */", " * do not edit by hand\n */") + "let a\n") == "generated"
    assert c("a/x.js", licence + "let a\n// @generated by tool\n") is None and c("a/x.js", licence + "export const a = typeof module === 'object';\n") is None


def test_copies_of_vendored_files(spark):
    rng = random.Random(4)
    name = lambda: "".join(rng.choices("abcdefghij", k=9))
    lines = lambda: [rng.choice(["  const {} = {}({}, 3);\n", "  if ({} && {}) return {};\n", "  {}.push({}).then({});\n", "  while ({} < {}) {}();\n"]).format(name(), name(), name()) for _ in range(40)]
    theirs = lines()
    body, mine = "".join(theirs), "".join(lines())
    rows = [("a/vendor/lib.js", body), ("b/src/copy.js", body.replace(theirs[3], "  patched();\n")), ("b/src/own.js", mine), ("b/src/own.js", mine), ("c/empty.js", ""), ("c/null.js", None)]
    kinds = {r.path: r.kind for r in handwritten.classify_files(spark.createDataFrame([(*r, "k") for r in rows], "path string, source string, kind string")).collect()}
    assert kinds == {"a/vendor/lib.js": "vendored", "b/src/copy.js": "vendored", "b/src/own.js": None, "c/empty.js": None}
    assert handwritten.classify_files(spark.createDataFrame([], "path string, source string")).count() == 0


def test_copy_of_any_version_is_found(spark):
    rng = random.Random(7)
    line = lambda: "  " + "".join(rng.choices("abcdefghij", k=24)) + "();\n"
    base = [line() for _ in range(26)]  # in every version; versions overlap by less than 0.5
    versions = [base + [line() for _ in range(14)] for _ in range(150)]
    rows = [(f"a/vendor/v{i}/lib.js", "".join(v)) for i, v in enumerate(versions)] + [(f"b/src/c{i}.js", "".join(v[:-1]) + "  patched();\n") for i, v in enumerate(versions)]
    kinds = {r.path: r.kind for r in handwritten.classify_files(spark.createDataFrame(rows, "path string, source string")).collect()}
    assert len(kinds) == 300 and set(kinds.values()) == {"vendored"}


def test_cross_pairs_of_large_buckets(spark, rows):
    left, right = [(i % 2, i) for i in range(50)], [(i % 3, 100 + i) for i in range(30)]
    got = bucket_cross(*[spark.createDataFrame(x, "bucket int, id int") for x in (left, right)], 80, chunk=4, heavy_floor=10)
    assert rows(got) == sorted({(i, j) for b, i in left for c, j in right if b == c}, key=str)


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    vocab = ["alpha", "Bête", "straße", "x1", "γ", "two", "words", "again"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(5, 40)))) for i in range(8)] + [(50, "short one"), (51, None), (52, "")]
    docs = []
    for d in range(40):
        text = " ".join(rng.choices(vocab, k=rng.randrange(0, 20)))
        if rng.random() < 0.5:
            w = words(rng.choice(items[:8])[1])
            a = rng.randrange(max(1, len(w) - 14))
            text += "\n\n> **" + ", ".join(w[a : a + rng.randrange(8, 20)]).upper() + "**\n"
        docs.append((d, text))
    docs += docs[:3] + [(100, None), (None, "x"), (101, "")]
    grams = lambda t: {tuple(words(t)[i : i + 12]) for i in range(len(words(t)) - 11)}
    want = {(d, i) for d, t in docs if d is not None and t for i, s in items if s and grams(t) & grams(s)}
    df = spark.createDataFrame([(*r, "w", 1) for r in docs], "doc_id bigint, text string, words string, item_id int")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    runs = lambda t: [tuple(words(t)[i:j]) for i in range(len(words(t))) for j in range(i + 12, len(words(t)) + 1)]
    text_of, item_of = {d: t for d, t in docs if t}, dict(items)
    for shard, part in ((30, 50), (1_000_000, 2_000_000)):
        hits = leaked_passages(df, it, shard_words=shard, pass_words=part)
        found = hits.collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and want
        for r in found:
            d, i = words(text_of[r.doc_id]), words(item_of[r.item_id])
            assert d[r.doc_word : r.doc_word + r.words] == i[r.item_word : r.item_word + r.words]
            assert r.words == max(map(len, set(runs(text_of[r.doc_id])) & set(runs(item_of[r.item_id]))))
    assert {r.item_id for r in leaked_items(hits).collect()} == {i for _, i in want}
    assert {r.doc_id for r in without_leaks(df.where("doc_id is not null"), hits).collect()} == {d for d, _ in docs if d is not None} - {d for d, _ in want}
    assert leaked_passages(df.limit(0), it).count() == 0 and leaked_passages(df, it.limit(0)).count() == 0


def test_repeated_words_stay_linear():
    docs, items = [np.full(16_000, 5, np.int64)], np.append(np.full(4_000, 5, np.int64), -1)
    tracemalloc.start()
    got = shard_hits(docs, [1], items, np.full(4_001, 9), 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(1, 9, 4_000, 0, 0)] and peak < 50_000_000


def test_longest_match(spark):
    text = " ".join(f"w{i}" for i in range(30))
    hits = leaked_passages(spark.createDataFrame([(1, "a " + text + " b")], "doc_id bigint, text string"), spark.createDataFrame([(7, "c " + text[:70])], "item_id bigint, text string"))
    assert hits.first()["words"] == len(set(words(text[:70])) & set(words(text)))


def test_flight_keeps_totals():
    rng = random.Random(2)
    pi, size = [rng.random() for _ in range(300)], [float(rng.randrange(1, 500)) for _ in range(300)]
    out = flight(pi, size, random.Random(1))
    assert sum(0 < p < 1 for p in out) <= 2
    assert abs(sum(out) - sum(pi)) < 1e-6 and abs(sum(p * s for p, s in zip(out, size)) - sum(p * s for p, s in zip(pi, size))) < 1e-4
    assert set(land(out, size, random.Random(1))) <= {0.0, 1.0}


def test_mix(spark):
    rng = random.Random(7)
    docs = [(i, "word " * rng.randrange(5, 60), rng.choice(["Big-One", "big_one", "BIG ONE"])) for i in range(400)] + [(1000 + i, "few words here", "small") for i in range(30)] + [(2000, None, "small"), (2001, "x", None), (None, "x", "small"), (2002, "", "small")]
    df = spark.createDataFrame(docs + docs[:10], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big_one", 0.6, 1), ("small", 0.2, 3), ("absent", 0.2, 5), ("bad", None, 1), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    for chunk in (50, 20_000):
        uses, shares = mix(df, targets, chunk=chunk)
        got = {r.source: r for r in shares.collect()}
        assert set(got) == {"big_one", "small"} and abs(got["big_one"].share - 0.75) < 0.02
        rows = uses.collect()
        assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.copies <= {"big_one": 1, "small": 3}[r.source] for r in rows)
        assert max(r.copies for r in rows if r.source == "small") == 3
    uses, shares = mix(df.limit(0), targets)
    assert uses.count() == 0 and shares.count() == 0


def test_endings():
    e = lambda t: truncation.ending(t)[0]
    for whole in ("", "A sentence.", "Why?", "Done!  \n", "He said \"so.\"", "Text.\n\n```ts\nf(1);\n```", "Text.\n\nFixes #12", "Text.\n\n-- the release bot", "Text.\n\nsee docs/a_b.md", "Text.\n\n## Part\n\nnone", "Text.\n\n(cc @team)", "| a | b |\n|---|---|\n| 1 | 2 |"):
        assert e(whole) == truncation.COMPLETE, whole
    for cut in ("It is &am", "It is <sp", "Text \\u00", "see [the docs](http://x", "Text.\n\n```ts\nf(1", "the code `abc", "half a lett\ufffd", "- a longer bullet that ends in the mid", "- One item.\n- Another it"):
        assert e(cut) == truncation.INCOMPLETE, cut
    for cut in ("The rule is of", "A list of one,"):
        assert e(cut) == truncation.OPEN, cut
    for either in ("That is all for now...", "Text.\n\n- a first one\n- two words"):
        assert e(either) == truncation.EITHER, either
    assert e("See src/a/b.") == truncation.COMPLETE
    assert e("run a\nrun b\nrun c\nrun d\ndone in 4 ms") == truncation.LOG


def test_closing_lines_are_learned(spark):
    docs = [(i, f"Some words about part {i}.\n\nover and out", "a") for i in range(20)] + [(100 + i, f"Some words about part {i} and then w{'x' * i}", "a") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    assert {r.doc_id for r in truncation.truncated_documents(df).collect()} == set(range(100, 160))


def test_limits_and_truncated(spark):
    rng = random.Random(5)
    docs, cut = [], set()
    for i in range(1500):
        text = " ".join("x" * rng.randrange(1, 12) for _ in range(rng.randrange(8, 70))) + f" {i}."
        if len(text) > 150 and rng.random() < 0.6:
            text = text[:147] + "..."
            cut.add(i)
        docs.append((i, text, rng.choice(["Pull-Request", "pull_request"])))
    docs += [(5000, "Ends in the mid", None), (5001, "Whole.", "tiny"), (5002, None, "x"), (None, "y", "x"), (5003, "Later...", "tiny")] + docs[:5]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, chars int")
    limits = truncation.judged(df)[1].collect()
    assert {(r.source, r.unit, r.length) for r in limits} == {("pull_request", "chars", 150), ("pull_request", "bytes", 150)}
    assert {r.doc_id for r in truncation.truncated_documents(df).collect()} == cut | {5000}
    assert {r.source: r.truncated for r in truncation.truncation_rates(df).collect()}["pull_request"] == len(cut)
    assert truncation.truncated_documents(df.limit(0)).count() == 0
