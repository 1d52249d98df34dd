"""Reports of an analysis.

Those for people are bounded selections made in Spark and rendered on the driver
from at most a few dozen rows each. Those for machines (JSON, SARIF, differences)
hold every issue: executors turn rows into JSON text in a total order and write
it, and the parts are copied into one document as streams, so no row passes the
driver's memory unless the text itself is asked for.
"""

from __future__ import annotations

import html as html_escape
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import common_prefix_dir, file_name, markdown_cell, mermaid_id, mermaid_label
from codeloom.operators.clones import clone_families, mirrored_directories
from codeloom.operators.graph import neighbourhood
from codeloom.operators.summary import files_at_risk, issues_per_file, top_issues
from codeloom.plans.analyze import Analysis
from codeloom.session import drop_path, filesystem, materialize, read_text, shared_dir

TOOL, VERSION = "codeloom", "0.2.0"
LIMITS = {"dead_code": 50, "unused_exports": 20, "duplicate_code": 10}
COMPACT_FROM = 1000


def _rows(df: DataFrame, most: int | None = None) -> list[dict]:
    return [r.asDict(recursive=True) for r in (df.limit(most) if most else df).collect()]


def totals(summary: DataFrame) -> dict:
    return summary.first().asDict()


def stream_document(spark: SparkSession, pieces: list, path: str) -> str:
    """Write one document of texts and of tables with one column of text: a DataFrame gives lines, a tuple of one the comma-separated elements of an array, in order."""
    folder, jvm = shared_dir(spark, "document"), spark.sparkContext._jvm
    fs, target = filesystem(spark, path)
    out = fs.create(target, True)
    try:
        for n, piece in enumerate(pieces):
            if isinstance(piece, str):
                out.write(bytearray(piece.encode()))
                continue
            elements = isinstance(piece, tuple)
            df = piece[0] if elements else piece
            line = F.col(df.columns[0])
            df.select((F.concat(F.lit(","), line) if elements else line).alias("value")).write.mode("overwrite").text(f"{folder}/{n}")
            inner, where = filesystem(spark, f"{folder}/{n}")
            parts = sorted((x.getPath() for x in inner.listStatus(where) if x.getPath().getName().startswith("part-") and x.getLen()), key=lambda x: x.getName())
            for i, part in enumerate(parts):
                stream = inner.open(part)
                stream.skip(1 if elements and not i else 0)  # the comma before the first element
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 65536, False)
                stream.close()
    finally:
        out.close()
    drop_path(spark, folder)
    return path


def _document(spark: SparkSession, pieces: list, path: str | None) -> str:
    """The document's path, or its text where no path is given."""
    return stream_document(spark, pieces, path) if path else read_text(spark, stream_document(spark, pieces, f"{shared_dir(spark, 'report')}.txt"))


def _elements(df: DataFrame, order: list[str] | None = None) -> tuple[DataFrame]:
    """Rows as JSON text, in the order of all their columns unless another is given."""
    by = order or df.columns
    return (df.select(F.to_json(F.struct(*df.columns)).alias("json"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(by)]).orderBy(*[f"o{i}" for i in range(len(by))]).select("json"),)


def json_report(a: Analysis, path: str | None = None) -> str:
    """Version, summary, frameworks, monorepo, every issue of each category and the duplication section; indented while the issues are few. With a path the document is written there."""
    spark, head = a.files.sparkSession, totals(a.summary())
    start = {"$schema": f"https://json-schema.org/{TOOL}/analysis-{VERSION}", "version": VERSION, "summary": head, "detected_frameworks": [f for f in a.frameworks if f != "generic"], "monorepo": {"kind": a.monorepo[0], "packages": a.monorepo[1]} if a.monorepo[0] else None}
    pieces: list = [json.dumps(start, ensure_ascii=False)[:-1] + ', "issues": {']
    for i, (category, df) in enumerate(a.issues.items()):
        pieces += [(", " if i else "") + json.dumps(category) + ": [", _elements(df), "]"]
    groups = a.instances.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("file", "start_line", "end_line"))).alias("instances"))
    pieces += ['}, "duplication": {"stats": ' + json.dumps(a.duplication.first().asDict(), ensure_ascii=False) + ', "clone_groups": [', _elements(groups, ["group_id"]), '], "clone_families": [', _elements(clone_families(a.instances))]
    pieces += ['], "mirrored_directories": [', _elements(mirrored_directories(a.instances)), '], "repetitive_patterns": [', _elements(a.patterns()), "]}}\n"]
    if sum(head[k] for k in ("dead_code", "unused_exports", "gotchas", "duplicate_code")) > COMPACT_FROM:
        return _document(spark, pieces, path)
    text = json.dumps(json.loads(_document(spark, pieces, None)), indent=2, ensure_ascii=False)
    return stream_document(spark, [text], path) if path else text


# Rules of the exchange format with their default levels.
SARIF_RULES = (
    ("dead_code", "Dead code", "No entry point reaches the file.", "warning"), ("unused_export", "Unused export", "No file imports the export.", "note"), ("unused_type", "Unused type", "No file imports the exported type.", "note"),
    ("duplicate_code", "Duplicate code", "Like code stands in several places.", "note"), ("gotcha", "Gotcha", "A pattern that is prone to errors.", "warning"), ("circular_dependency", "Circular dependency", "Files import each other in a circle.", "warning"),
    ("duplicate_export", "Duplicate export", "Several files export the same name.", "warning"), ("unresolved_import", "Unresolved import", "No file was found for the import.", "warning"),
    ("unused_dependency", "Unused dependency", "A listed package is never imported.", "note"), ("unlisted_dependency", "Unlisted dependency", "An imported package is not listed.", "warning"),
)
SURE = "if(confidence >= 0.8, 'warning', 'note')"
# category → (rule, level, message, places as an array of (file, line), properties), over the detector's columns
SARIF = {
    "dead_code": ("dead_code", SURE, "reason", "array(named_struct('f', path, 'l', 1L))", "named_struct('confidence', confidence, 'lines_of_code', lines_of_code)"),
    "unused_exports": ("unused_export", "'note'", "concat('Export ''', name, ''' is never imported')", "array(named_struct('f', path, 'l', 1L))", None),
    "unused_types": ("unused_type", "'note'", "concat(kind, ' ''', name, ''' is never imported')", "array(named_struct('f', path, 'l', 1L))", None),
    "duplicate_code": ("duplicate_code", SURE, "concat('Like code in ', file_a, ' (L', start_a, '-L', end_a, ') and ', file_b, ' (L', start_b, '-L', end_b, ')')", "array(named_struct('f', file_a, 'l', start_a), named_struct('f', file_b, 'l', start_b))", "named_struct('confidence', confidence)"),
    "gotchas": ("gotcha", "case severity when 'error' then 'error' when 'warning' then 'warning' else 'note' end", "message", "array(named_struct('f', file, 'l', line))", "named_struct('confidence', confidence, 'rule', rule)"),
    "circular_dependencies": ("circular_dependency", "'warning'", "concat('Circular dependency: ', concat_ws(' → ', files), ' → ', files[0])", "array(named_struct('f', files[0], 'l', 1L))", None),
    "duplicate_exports": ("duplicate_export", "'warning'", "concat('Export ''', name, ''' stands in ', size(locations), ' places')", "transform(locations, x -> named_struct('f', x, 'l', 1L))", None),
    "unresolved_imports": ("unresolved_import", "'warning'", "concat('Unresolved import ''', spec, ''' in ', source)", "array(named_struct('f', source, 'l', 1L))", None),
    "unused_dependencies": ("unused_dependency", "'note'", "concat('Package ''', package, ''' is listed but never imported')", "array(named_struct('f', 'package.json', 'l', 1L))", None),
    "unlisted_dependencies": ("unlisted_dependency", "'warning'", "concat('''', package, ''' imported by ', path, ' but not listed')", "array(named_struct('f', path, 'l', 1L))", None),
}


def sarif_results(category: str, issues: DataFrame) -> DataFrame:
    """result: one SARIF result as JSON text for each issue. Control characters leave paths and become blanks in messages; critical findings are notes, as the table of levels has no entry for them."""
    rule, level, message, places, properties = SARIF[category]
    uri = lambda c: F.regexp_replace(F.regexp_replace(c, r"\p{Cntrl}", ""), r"\\", "/")
    spots = F.transform(F.expr(f"cast({places} as array<struct<f:string,l:bigint>>)"), lambda p: F.struct(F.struct(F.struct(uri(p["f"]).alias("uri")).alias("artifactLocation"), F.struct(p["l"].alias("startLine")).alias("region")).alias("physicalLocation")))
    parts = [F.lit(rule).alias("ruleId"), F.expr(level).alias("level"), F.struct(F.regexp_replace(F.expr(message), r"\p{Cntrl}", " ").alias("text")).alias("message"), spots.alias("locations")]
    if properties:
        parts.append(F.expr(properties).alias("properties"))
    return issues.select(F.to_json(F.struct(*parts)).alias("result"))


def sarif(issues: dict[str, DataFrame], path: str | None = None, tool: str = TOOL) -> str:
    """Every issue of all categories but plug-in issues as one SARIF document, with the rules."""
    spark = next(iter(issues.values())).sparkSession
    rules = [{"id": i, "name": n, "shortDescription": {"text": d}, "defaultConfiguration": {"level": level}} for i, n, d, level in SARIF_RULES]
    driver = json.dumps({"name": tool, "version": VERSION, "rules": rules}, ensure_ascii=False)
    every = None
    for i, category in enumerate(k for k in SARIF if k in issues):
        part = sarif_results(category, issues[category]).select("result", F.lit(i).alias("o"))
        every = part if every is None else every.union(part)
    pieces = ['{"$schema": "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": ' + driver + '}, "results": [']
    return _document(spark, [*pieces, *([(every.orderBy("o", "result").select("result"),)] if every is not None else []), "]}]}\n"], path)


def health_bar(score: float) -> str:
    full = int(score / 5)
    return "█" * full + "░" * (20 - full)


def mark(score: float, good: float = 80, fair: float = 50) -> str:
    return "🟢" if score >= good else "🟡" if score >= fair else "🔴"


def _cell(x) -> str:
    text = "" if x is None else str(x)
    for a, b in (("|", "\\|"), ("[", "\\["), ("]", "\\]"), ("`", "\\`"), ("<", "&lt;"), (">", "&gt;"), ("\n", " "), ("\r", " ")):
        text = text.replace(a, b)
    return text


def _table(rows: list[dict], cols: list[str]) -> str:
    return "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *["| " + " | ".join(_cell(r.get(c)) for c in cols) + " |" for r in rows]])


def markdown(summary: DataFrame, issues: DataFrame) -> str:
    s = totals(summary)
    parts = [f"# Code analysis\n\n{mark(s['health_score'])} {health_bar(s['health_score'])} {s['health_score']}/100\n\n{s['total_files']} files, {s['total_lines']} lines of code, {s['duplication_percentage']:.1f} % duplicated"]
    for category, most in LIMITS.items():
        rows = _rows(issues.where(F.col("category") == category).orderBy(F.desc("impact"), "file", "line", "reason"), most)
        if rows:
            parts.append(f"## {category} ({s[category]})\n\n" + _table(rows, ["file", "line", "impact", "confidence", "reason"]))
    return "\n\n".join(parts) + "\n"


def ai_report(summary: DataFrame, issues: DataFrame) -> str:
    return json.dumps({"summary": totals(summary), "top_issues": _rows(top_issues(issues.drop("files"))), "files_at_risk": _rows(files_at_risk(issues))}, indent=2, ensure_ascii=False)


def context(summary: DataFrame, issues: DataFrame) -> str:
    """Four lines for a prompt; more than 999 lines of code are given in whole thousands."""
    s = totals(summary)
    loc = f"{s['total_lines'] // 1000}K" if s["total_lines"] > 999 else str(s["total_lines"])
    risk = issues.where("category = 'unused_exports'").groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").first()
    return "\n".join([f"health {s['health_score']}/100", f"{s['total_files']} files, {loc} LOC", f"dead {s['dead_code']}, unused exports {s['unused_exports']}, cycles {s['circular_dependencies']}", f"riskiest {risk['file'] if risk else '-'}"])


def html(summary: DataFrame, issues: DataFrame) -> str:
    """A page of its own: heat map of 20 files, 30 dead files, 30 exports and 15 clones, with the data as JSON that can't end its script."""
    data = {"summary": totals(summary), "heat": _rows(issues_per_file(issues).orderBy(F.desc("issues"), "file"), 20)}
    for category, most in (("dead_code", 30), ("unused_exports", 30), ("duplicate_code", 15)):
        data[category] = _rows(issues.where(F.col("category") == category).orderBy(F.desc("impact"), "file", "reason"), most)
    blob = json.dumps(data, ensure_ascii=False).replace("</", "<\\/").replace("<!--", "<\\!--")
    rows = "".join(f"<tr><td>{html_escape.escape(r['file'])}</td><td>{r['issues']}</td></tr>" for r in data["heat"])
    return f"<!doctype html><meta charset=utf-8><title>Code analysis</title><h1>{data['summary']['health_score']}/100</h1><table>{rows}</table><script type=application/json id=data>{blob}</script>"


def cycle_files(issues: DataFrame) -> DataFrame:
    return issues.where("category = 'circular_dependencies'").select(F.explode(F.coalesce("files", F.array("file"))).alias("path"))


def important_files(edges: DataFrame, issues: DataFrame, entries: DataFrame | None = None, most_by_issues: int = 10) -> DataFrame:
    """path: dead files, entry points, files on cycles and the ten files with the most issues, with all files one import away."""
    nodes = edges.select(F.col("source").alias("path")).union(edges.select("target")).distinct()
    worst = issues_per_file(issues).withColumnRenamed("file", "path").join(nodes, "path", "left_semi").orderBy(F.desc("issues"), "path").limit(most_by_issues).select("path")
    chosen = issues.where("category = 'dead_code'").select(F.col("file").alias("path")).union(cycle_files(issues)).union(worst)
    if entries is not None:
        chosen = chosen.union(entries.select("path"))
    return neighbourhood(edges, chosen.join(nodes, "path", "left_semi"))


def mermaid(edges: DataFrame, issues: DataFrame, entries: DataFrame | None = None, most: int = 30, path: str | None = None) -> str:
    """A graph of the imports in boxes of folders below the common prefix of all paths.

    Of more than ``most`` files those of ``important_files`` are shown. Dead files,
    entries, files on cycles and the five files with the most issues are marked.
    With a path the graph is written there.
    """
    pairs = edges.select("source", "target").distinct()
    nodes = pairs.select(F.col("source").alias("path")).union(pairs.select("target")).distinct()
    if nodes.limit(most + 1).count() > most:
        nodes = materialize(important_files(edges, issues, entries), "graph-files")
        pairs = pairs.join(nodes.withColumnRenamed("path", "source"), "source", "left_semi").join(nodes.withColumnRenamed("path", "target"), "target", "left_semi").select("source", "target")
    prefix = nodes.agg(F.array(F.min("path"), F.max("path")).alias("p")).select(common_prefix_dir(F.col("p")).alias("prefix")).first()["prefix"] or ""
    short = F.expr(f"substring(path, {len(prefix) + 1})")
    ident = lambda c: F.concat(F.lit("n_"), mermaid_id(F.col(c)), F.lit("_"), F.substring(F.md5(c), 1, 4))
    boxed = nodes.select("path", F.when(short.contains("/"), F.regexp_replace(short, r"/[^/]*$", "")).otherwise(F.lit("(root)")).alias("dir"), ident("path").alias("id"), mermaid_label(file_name(F.col("path"))).alias("label"))
    node = boxed.select("dir", F.lit(1).alias("o"), "path", F.concat(F.lit('    '), "id", F.lit('["'), "label", F.lit('"]')).alias("line"))
    box = lambda o, line: boxed.select("dir").distinct().select("dir", F.lit(o).alias("o"), F.lit("").alias("path"), line.alias("line"))
    opened = box(0, F.concat(F.lit('  subgraph "'), mermaid_label(F.col("dir")), F.lit('"')))
    arrows = pairs.select(F.concat(F.lit("  "), ident("source"), F.lit(" --> "), ident("target")).alias("line")).orderBy("line")
    hot = issues_per_file(issues).withColumnRenamed("file", "path").join(nodes, "path", "left_semi").orderBy(F.desc("issues"), "path").limit(5).select("path", F.lit("hot").alias("mark"))
    marks = hot.union(issues.where("category = 'dead_code'").select("file", F.lit("dead"))).union(cycle_files(issues).select("path", F.lit("cycle")))
    if entries is not None:
        marks = marks.union(entries.select("path", F.lit("entry")))
    classes = marks.distinct().join(nodes, "path", "left_semi").select(F.concat(F.lit("  class "), ident("path"), F.lit(" "), "mark").alias("line")).orderBy("line")
    boxes = opened.union(node).union(box(2, F.lit("  end"))).orderBy("dir", "o", "path").select("line")
    text = _document(edges.sparkSession, ["graph LR\n", boxes, arrows, classes], path)
    return text if path else text.rstrip("\n")


def pr_comment(summary: DataFrame, issues: DataFrame) -> str:
    s = totals(summary)
    out = [f"{mark(s['health_score'], 80, 60)} **{s['health_score']}/100**"]
    for category, most in (("dead_code", 3), ("unused_exports", 3), ("gotchas", 2), ("circular_dependencies", 2)):
        out += [f"- {_cell(r['file'])}: {_cell(r['reason'])}" for r in _rows(issues.where(F.col("category") == category).orderBy(F.desc("impact"), "file", "reason"), most)]
    return "\n".join(out[:1] + out[1:6])


def dashboard(summary: DataFrame, issues: DataFrame) -> str:
    """Text for a terminal: score, counts and the ten leading issues."""
    s = totals(summary)
    lines = [f"health {health_bar(s['health_score'])} {s['health_score']}"]
    lines += [f"{k:<24}{v}" for k, v in s.items() if isinstance(v, int)]
    return "\n".join(lines + [f"{i + 1:>2}. {r['category']} {r['file']} {r['reason']}" for i, r in enumerate(_rows(top_issues(issues, 10)))])


def fix_hints(issues: DataFrame) -> DataFrame:
    """text: one hint for each sure dead file, and one for each file with unused exports, in order."""
    dead = issues.where("category = 'dead_code' and confidence >= 0.8").select(F.concat(F.lit("# delete "), F.col("file"), F.lit(" ("), F.col("impact").cast("bigint"), F.lit(" lines)")).alias("text"), F.lit(0).alias("o"), (-F.col("confidence")).alias("c"), (-F.col("impact")).alias("i"), "file")
    exports = issues.where("category = 'unused_exports'").groupBy("file").agg(F.sort_array(F.collect_list("reason")).alias("r")).select(F.concat(F.lit("# in "), F.col("file"), F.lit(": "), F.array_join("r", "; ")).alias("text"), F.lit(1).alias("o"), F.lit(0.0).alias("c"), F.lit(0.0).alias("i"), "file")
    return dead.unionByName(exports).orderBy("o", "c", "i", "file").select("text")


def diff_json(changes: DataFrame, path: str | None = None) -> str:
    """new_issues, fixed_issues and persisting, every row of each."""
    pieces: list = []
    for i, (status, name) in enumerate((("new", "new_issues"), ("fixed", "fixed_issues"), ("persisting", "persisting"))):
        pieces += [("{" if not i else ", ") + json.dumps(name) + ": [", _elements(changes.where(F.col("status") == status).drop("status")), "]"]
    return _document(changes.sparkSession, [*pieces, "}\n"], path)


def diff_markdown(changes: DataFrame, net: DataFrame, most: int = 30, path: str | None = None) -> str:
    """All new and fixed issues, persisting ones while they are at most ``most``, and the net of each category."""
    counts = {r["status"]: r["n"] for r in changes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces: list = [f"# Differences\n\nnew {counts.get('new', 0)}, fixed {counts.get('fixed', 0)}, persisting {counts.get('persisting', 0)}\n"]
    detail = F.col("detail") if "detail" in changes.columns else F.col("key")
    for status in ("new", "fixed", "persisting"):
        if counts.get(status):
            pieces.append(f"\n## {status} ({counts[status]})\n")
        if counts.get(status) and (status != "persisting" or counts[status] <= most):
            line = F.concat(F.lit("| "), markdown_cell(F.col("category")), F.lit(" | "), markdown_cell(detail), F.lit(" |"))
            pieces += ["\n| category | issue |\n|---|---|\n", changes.where(F.col("status") == status).orderBy("category", "key").select(line.alias("line"))]
    signed = F.concat(F.when(F.col("net") > 0, "+").otherwise(""), F.col("net").cast("string"))
    row = F.concat(F.lit("| "), markdown_cell(F.col("category")), F.lit(" | "), F.col("new").cast("string"), F.lit(" | "), F.col("fixed").cast("string"), F.lit(" | "), signed, F.lit(" |"))
    return _document(changes.sparkSession, [*pieces, "\n## by category\n\n| category | new | fixed | net |\n|---|---|---|---|\n", net.orderBy("category").select(row.alias("line"))], path)
