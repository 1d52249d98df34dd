"""Lint rules over lines of source, as data, and their evaluation as one pass over the lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.predicates import is_comment_line, is_example_or_script, is_test_file
from codeloom.functions.text import text_lines, trim_all, truncate_bytes

JS_EXT, RS_EXT = r"\.(ts|tsx|js|jsx)$", r"\.rs$"


@dataclass(frozen=True)
class LineRule:
    """A line breaks the rule if it has any needle and no exclusion."""

    rule: str
    family: str  # js, rs or any
    needles: tuple[str, ...]
    severity: str
    confidence: float
    message: str
    exclusions: tuple[str, ...] = ()
    skip_examples: bool = False
    comment: bool = False  # looks at comment lines, otherwise at all others
    after_needle: bool = False  # exclusions count behind the needle only
    macro: bool = False  # the needle counts at a word boundary outside strings


# The rules, with the texts that break them.
LINE_RULES = (
    LineRule("loose-equality", "js", ("==",), "info", 0.4, "Use `===` instead of `==`", ("===", "!==", "<=", ">=", "=>"), skip_examples=True),
    LineRule("loose-inequality", "js", ("!=",), "info", 0.4, "Use `!==` instead of `!=`", ("!==",), skip_examples=True),
    LineRule("eval-usage", "js", ("eval(",), "critical", 0.95, "`eval()` runs arbitrary code"),
    LineRule("xss-innerhtml", "js", (".innerHTML",), "critical", 0.9, "`innerHTML` may let scripts in"),
    LineRule("xss-dangerously-set", "js", ("dangerouslySetInnerHTML",), "critical", 0.95, "`dangerouslySetInnerHTML` may let scripts in"),
    LineRule("any-type", "js", (": any",), "warning", 0.9, "`any` turns type checks off"),
    LineRule("as-any-cast", "js", ("as any",), "warning", 0.95, "a cast to `any` turns type checks off"),
    LineRule("any-cast-angle", "js", ("<any>",), "warning", 0.7, "a cast to `any` turns type checks off"),
    LineRule("console-statement", "js", ("console.log(", "console.debug("), "info", 0.4, "console output left in the code", skip_examples=True),
    LineRule("unresolved-comment", "any", ("TODO:", "FIXME:", "HACK:", "XXX:"), "info", 0.5, "unresolved note in a comment", comment=True),
    LineRule("env-no-fallback", "js", ("process.env.",), "info", 0.7, "environment variable without fallback", ("||", "??", "?.", "? "), after_needle=True),
    LineRule("rust-unwrap", "rs", (".unwrap()",), "warning", 0.5, "`.unwrap()` can panic"),
    LineRule("rust-panic", "rs", ("panic!(",), "warning", 0.8, "`panic!()` ends the thread", macro=True),
    LineRule("rust-todo", "rs", ("todo!(",), "warning", 0.9, "`todo!()` panics when reached", macro=True),
    LineRule("rust-unimplemented", "rs", ("unimplemented!(",), "warning", 0.9, "`unimplemented!()` panics when reached", macro=True),
    LineRule("rust-println", "rs", ("println!(",), "info", 0.3, "print statement left in the code", skip_examples=True),
    LineRule("rust-dbg", "rs", ("dbg!(",), "info", 0.7, "`dbg!()` left in the code", macro=True),
)
SEVERITIES = ("critical", "warning", "info")


@dataclass(frozen=True)
class FileRule:
    """A framework rule over a whole file: all needles, any needle, or a needle without exclusions in text or path; or a regular expression per line."""

    rule: str
    kind: str  # all, any, but_not or regex
    needles: tuple[str, ...]
    severity: str
    confidence: float
    message: str
    exclusions: tuple[str, ...] = ()
    profile: str = "generic"


# The framework rules.
FILE_RULES = (
    FileRule("nextjs-client-types-only", "all", ("'use client'", "export type", "export interface"), "warning", 0.8, "a client file that only exports types", profile="nextjs"),
    FileRule("nextjs-metadata-in-client", "all", ("'use client'", "export const metadata"), "warning", 0.85, "`metadata` in a client file is ignored", profile="nextjs"),
    FileRule("nextjs-static-params-location", "but_not", ("generateStaticParams",), "warning", 0.75, "`generateStaticParams` works in pages and routes only", ("/page.tsx", "/route.ts", "page.ts", "route.ts"), profile="nextjs"),
    FileRule("nestjs-body-without-dto", "but_not", ("@Body()",), "warning", 0.75, "request body without a validated class", ("CreateDto", "UpdateDto", "DTO", "Dto", ".dto"), profile="nestjs"),
)


def lines_of(files: DataFrame) -> DataFrame:
    """path, line_no (1-based), text of every line of every readable file."""
    return files.where("path is not null and source is not null").select("path", F.posexplode(text_lines(F.col("source"))).alias("p", "text")).select("path", (F.col("p") + 1).cast("bigint").alias("line_no"), "text")


def _outside_strings(text: Column) -> Column:
    """The line without whole string literals; an unterminated one hides the rest."""
    raw = F.regexp_replace(text, r'r(#*)"(?:(?!"\1).)*+(?:"\1|$)', "")
    return F.regexp_replace(raw, r'"(?:[^"\\]|\\.)*+(?:"|$)', "")


def _breaks(rule: LineRule, text: Column, path: Column, comment: Column) -> Column:
    body = _outside_strings(text) if rule.macro else text
    if rule.macro:
        hit = body.rlike("(?<![A-Za-z0-9_])" + rule.needles[0].replace("(", r"\("))
    else:
        hit = F.lit(False)
        for n in rule.needles:
            hit = hit | body.contains(n)
    tail = F.substring(text, F.locate(rule.needles[0], text), F.length(text)) if rule.after_needle else text
    for x in rule.exclusions:
        hit = hit & ~tail.contains(x)
    if rule.rule == "rust-panic":
        hit = hit & ~F.substring_index(text, "panic!(", 1).rlike(r"unwrap_or_else\(|ok_or_else\(")
    hit = hit & (comment if rule.comment else ~comment)
    if rule.family != "any":
        hit = hit & path.rlike(JS_EXT if rule.family == "js" else RS_EXT)
    if rule.skip_examples:
        hit = hit & ~is_example_or_script(path)
    return hit


def _suspected(rules, text: Column, path: Column) -> Column:
    """Whether a line can break a rule: it has a needle, or for macros a string literal, which may stand between the parts of one."""
    out = F.lit(False)
    for n in dict.fromkeys(n for r in rules for n in r.needles):
        out = out | text.contains(n)
    for family in dict.fromkeys(r.family for r in rules if r.macro):
        out = out | text.contains('"') & (F.lit(True) if family == "any" else path.rlike(JS_EXT if family == "js" else RS_EXT))
    return out


def _found(rule, cond: Column) -> Column:
    return F.when(cond, F.struct(F.lit(rule.rule).alias("rule"), F.lit(rule.severity).alias("severity"), F.lit(rule.message).alias("message"), F.lit(rule.confidence).alias("confidence")))


def line_issues(files: DataFrame, rules=LINE_RULES) -> DataFrame:
    """file, line, rule, severity, message, confidence, snippet: all line rules in one pass without a shuffle; test files are left out."""
    rows = lines_of(files.where(~is_test_file(F.col("path")))).where(_suspected(rules, F.col("text"), F.col("path"))).withColumn("comment", is_comment_line(F.col("text")))
    found = F.filter(F.array(*[_found(r, _breaks(r, F.col("text"), F.col("path"), F.col("comment"))) for r in rules]), lambda x: x.isNotNull())
    rows = rows.select("path", "line_no", "text", F.explode(found).alias("f"))
    return rows.select(F.col("path").alias("file"), F.col("line_no").alias("line"), "f.rule", "f.severity", "f.message", "f.confidence", truncate_bytes(trim_all(F.col("text")), 120, 117).alias("snippet"))


def file_issues(files: DataFrame, rules=FILE_RULES) -> DataFrame:
    """Framework rules, once for each file, at the first line with the needle."""
    if not rules:
        return files.select("path").limit(0).select(F.expr("cast(null as string) as file"), F.expr("0L as line"), *[F.expr(f"cast(null as {t}) as {c}") for c, t in (("rule", "string"), ("severity", "string"), ("message", "string"), ("confidence", "double"), ("snippet", "string"))])
    src, path = F.col("source"), F.col("path")
    texts = files.where("path is not null and source is not null").where(~is_test_file(path))
    found = []
    for r in rules:
        has = [src.contains(n) for n in r.needles]
        if r.kind == "regex":
            cond, pick = src.rlike("(?m)" + r.needles[0]), F.lit(r.needles[0])
        else:
            cond = has[0]
            for h in has[1:]:
                cond = (cond & h) if r.kind == "all" else (cond | h)
            pick = F.lit(r.needles[0])
            for n, h in zip(reversed(r.needles), reversed(has)):
                pick = F.when(h, F.lit(n)).otherwise(pick) if r.kind == "any" else pick
        for x in r.exclusions:
            cond = cond & ~src.contains(x) & ~path.contains(x)
        found.append(F.when(cond, F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"), F.lit(r.confidence).alias("confidence"), pick.alias("needle"), F.lit(r.kind == "regex").alias("regex"))))
    rows = texts.select("path", text_lines(src).alias("lines"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    at = F.array_position(F.transform("lines", lambda x: F.when(F.col("f.regex"), F.regexp_like(x, F.col("f.needle"))).otherwise(x.contains(F.col("f.needle")))), True)
    rows = rows.withColumn("at", at.cast("int")).where("at > 0")
    return rows.select(F.col("path").alias("file"), F.col("at").cast("bigint").alias("line"), "f.rule", "f.severity", "f.message", "f.confidence", truncate_bytes(trim_all(F.element_at("lines", F.col("at"))), 120, 117).alias("snippet"))


def unhandled_promises(files: DataFrame) -> DataFrame:
    """``.then(`` without ``.catch(`` on the line or the three after it; neighbours are read from the file's own array of lines."""
    texts = files.where("path is not null and source is not null").where(F.col("source").contains(".then(") & ~is_test_file(F.col("path")) & F.col("path").rlike(JS_EXT)).select("path", text_lines(F.col("source")).alias("lines"))
    rows = texts.select("path", "lines", F.posexplode("lines").alias("p", "text")).where(F.col("text").contains(".then(") & ~F.col("text").contains(".catch(") & ~is_comment_line(F.col("text")))
    nearby = F.exists(F.slice("lines", F.col("p") + 2, 3), lambda x: x.contains(".catch("))
    rows = rows.where(~F.when(F.col("p") + 2 > F.size("lines"), F.lit(False)).otherwise(nearby))
    return rows.select(
        F.col("path").alias("file"), (F.col("p") + 1).cast("bigint").alias("line"), F.lit("unhandled-promise").alias("rule"), F.lit("warning").alias("severity"),
        F.lit("`.then()` without `.catch()`").alias("message"), F.lit(0.7).alias("confidence"), truncate_bytes(trim_all(F.col("text")), 120, 117).alias("snippet"),
    )


def lookahead(events: DataFrame, key: str, order: list, starts: Column, answer: Column, within: int = 3) -> DataFrame:
    """Rows of ``starts`` without an ``answer`` among the next ``within`` rows of the same key."""
    ahead = Window.partitionBy(key).orderBy(*order).rowsBetween(1, within)
    return events.withColumn("_answered", F.max(answer.cast("int")).over(ahead)).where(starts & (F.coalesce("_answered", F.lit(0)) == 0)).drop("_answered")


def callback_hell(files: DataFrame) -> DataFrame:
    """The first line of each script that starts a function with four or more braces open before it; the count never falls below 0."""
    texts = files.where("path is not null and source is not null").where(~is_test_file(F.col("path")) & F.col("path").rlike(JS_EXT))

    def step(acc, text):
        marks = F.regexp_extract_all(text, F.lit(r"[{}]"), 0)
        depth = F.aggregate(marks, acc["depth"], lambda d, m: F.when(m == "{", d + 1).otherwise(F.greatest(d - 1, F.lit(0))))
        hit = (acc["line"] == 0) & (acc["depth"] >= 4) & ~is_comment_line(text) & (text.contains("function(") | text.contains("function (") | text.contains("=>"))
        return F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), F.when(hit, acc["n"] + 1).otherwise(acc["line"]).alias("line"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("line"))
    rows = texts.select("path", text_lines(F.col("source")).alias("lines")).withColumn("at", F.aggregate("lines", start, step, lambda a: a["line"])).where("at > 0")
    return rows.select(
        F.col("path").alias("file"), F.col("at").cast("bigint").alias("line"), F.lit("callback-hell").alias("rule"), F.lit("info").alias("severity"),
        F.lit("deeply nested callbacks").alias("message"), F.lit(0.5).alias("confidence"), truncate_bytes(trim_all(F.element_at("lines", F.col("at"))), 120, 117).alias("snippet"),
    )


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c), F.lit(0)).cast("int")


def ordered(issues: DataFrame) -> DataFrame:
    """By severity, file and line."""
    return issues.orderBy(F.when(severity_rank(F.col("severity")) == 0, 9).otherwise(severity_rank(F.col("severity"))), "file", "line", "rule")
