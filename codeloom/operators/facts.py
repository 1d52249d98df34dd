"""The fact tables of source files: one parse per file, exploded into relations, with a cache by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.rust_facts import rust_facts
from codeloom.functions.script_facts import LANG_FLAGS, script_facts
from codeloom.functions.text import count_loc, is_internal, package_name, text_lines
from codeloom.session import path_exists, read_text, swap_text

VERSION = 3
FACTS = (
    "path string, language string, sha string, loc bigint, total_lines bigint, functions bigint, classes bigint, complexity bigint, max_nesting_depth bigint, "
    "imports array<string>, named_imports array<struct<spec:string,name:string>>, exports array<string>, type_exports array<struct<name:string,kind:string>>, "
    "reexports array<struct<spec:string,name:string>>, blocks array<struct<name:string,kind:string,start_line:bigint,end_line:bigint,source:string>>, empty_catches array<bigint>, modules array<string>, "
    "parse_errors array<struct<message:string,line:bigint,column:bigint>>"
)


Reader = Callable[[str, str], dict]


def read_script(language: str, source: str) -> dict:
    f = script_facts(source, language)
    return dict(
        functions=f.functions, classes=f.classes, complexity=f.complexity, max_nesting_depth=f.max_nesting_depth, imports=f.imports,
        named_imports=[{"spec": s, "name": n} for s, n in f.named_imports], exports=f.exports, type_exports=[{"name": n, "kind": k} for n, k in f.type_exports],
        reexports=[{"spec": s, "name": n} for s, n in f.reexports], empty_catches=f.empty_catches, parse_errors=[{"message": m, "line": a, "column": b} for m, a, b in f.parse_errors],
        blocks=[{"name": n, "kind": k, "start_line": a, "end_line": b, "source": source[s:e]} for n, k, a, b, s, e in f.blocks],
    )


def read_rust(language: str, source: str) -> dict:
    exports, uses, mods, functions = rust_facts(source)
    return dict(exports=exports, functions=functions, complexity=1, named_imports=[{"spec": m, "name": n} for m, n in uses], imports=sorted({m for m, _ in uses}), modules=mods)


# language → reader (language, source) → facts; parse_files takes more
READERS: dict[str, Reader] = {**dict.fromkeys(LANG_FLAGS, read_script), "rust": read_rust}


def parse_one(language: str, source: str, readers: dict[str, Reader] | None = None) -> dict:
    """The facts of one text; a reader gives those it knows, languages without a reader give empty facts."""
    out = dict(functions=0, classes=0, complexity=0, max_nesting_depth=0, imports=[], named_imports=[], exports=[], type_exports=[], reexports=[], blocks=[], empty_catches=[], modules=[], parse_errors=[])
    reader = (readers or READERS).get(language)
    return out | reader(language, source) if reader else out


def parse_files(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Facts of every readable file (path, language, source); exact copies of a row count once, a null language has no reader. ``readers`` add languages or replace readers."""
    loc, total = count_loc(F.col("source"))
    table = READERS | (readers or {})
    known = F.coalesce("language", F.lit("")).isin(*table)
    rows = files.where("path is not null and source is not null").select("path", "language", "source").distinct()
    rows = rows.select("path", "language", "source", F.sha2("source", 256).alias("sha"), F.when(known, loc).otherwise(total).alias("loc"), total.alias("total_lines"))
    names = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            facts = pd.DataFrame([parse_one(lang or "", text, table) for lang, text in zip(pdf["language"], pdf["source"])], index=pdf.index)
            yield pd.concat([pdf.drop(columns="source"), facts], axis=1)[names] if len(pdf) else pd.DataFrame(columns=names)

    return rows.mapInPandas(run, FACTS)


class FactCache:
    """Facts kept by (path, content hash): a run parses only files whose pair is unknown and drops pairs that are gone.

    Raw specifiers are kept, and resolved anew in every run, as a target may
    come or go without the importer changing. A version other than ours or a
    missing pointer is an empty cache.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _pointer(self) -> tuple[int, int]:
        text = read_text(self.spark, f"{self.root}/CURRENT")
        parts = (text or "0 0").split()
        return (int(parts[0]), int(parts[1])) if len(parts) == 2 and all(p.isdigit() for p in parts) else (0, 0)

    def load(self) -> DataFrame:
        version, n = self._pointer()
        path = f"{self.root}/facts{n}"
        if version != VERSION or not n or not path_exists(self.spark, path):
            return self.spark.createDataFrame([], FACTS)
        return self.spark.read.schema(FACTS).parquet(path)

    def refresh(self, files: DataFrame) -> DataFrame:
        """Facts of the given files, from the cache where path and content are known; the new state is swapped in at the end."""
        old = self.load()
        now = files.where("path is not null and source is not null").select("path", "language", "source").distinct().withColumn("sha", F.sha2("source", 256))
        kept = old.join(now.select("path", "sha"), ["path", "sha"], "left_semi")
        fresh = parse_files(now.join(old.select("path", "sha"), ["path", "sha"], "left_anti").drop("sha"))
        n = self._pointer()[1] + 1
        kept.select(*fresh.columns).unionByName(fresh).write.mode("overwrite").parquet(f"{self.root}/facts{n}")
        swap_text(self.spark, f"{self.root}/CURRENT", f"{VERSION} {n}")
        return self.load()


def parse_errors(facts: DataFrame) -> DataFrame:
    """path, message, line, column of brackets without their partner."""
    return facts.select("path", F.inline("parse_errors"))


def exports(facts: DataFrame) -> DataFrame:
    return facts.select("path", F.explode("exports").alias("name"))


def type_exports(facts: DataFrame) -> DataFrame:
    return facts.select("path", F.inline("type_exports"))


def raw_imports(facts: DataFrame) -> DataFrame:
    """importer, spec of internal specifiers."""
    return facts.select(F.col("path").alias("importer"), F.explode("imports").alias("spec")).where(is_internal(F.col("spec")))


def external_imports(facts: DataFrame) -> DataFrame:
    """path, package of external specifiers; Rust paths are no packages."""
    specs = facts.where("language <> 'rust'").select("path", F.explode("imports").alias("spec")).where(~is_internal(F.col("spec")))
    return specs.select("path", package_name(F.col("spec")).alias("package")).where("package <> ''").distinct()


def dep_edges(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """source, target, resolved: the file where a specifier resolves, the specifier itself where it does not. resolved: importer, spec, target."""
    return resolved.select(F.col("importer").alias("source"), F.coalesce("target", "spec").alias("target"), F.col("target").isNotNull().alias("resolved")).distinct()


def imported_names(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """target, name, importer."""
    named = facts.select(F.col("path").alias("importer"), F.inline("named_imports"))
    return named.join(resolved.where("target is not null"), ["importer", "spec"]).select("target", "name", "importer").distinct()


def reexports(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """barrel, target, name (``*`` for all)."""
    named = facts.select(F.col("path").alias("importer"), F.inline("reexports"))
    return named.join(resolved.where("target is not null"), ["importer", "spec"]).select(F.col("importer").alias("barrel"), "target", "name").distinct()


def blocks(facts: DataFrame) -> DataFrame:
    return facts.select("path", F.inline("blocks"))


def import_line_names(files: DataFrame) -> DataFrame:
    """name: every identifier in the text of single-line imports, in any file; what unused types are held against."""
    lines = files.where("source is not null").select(F.explode(text_lines(F.col("source"))).alias("text")).where(F.col("text").rlike(r"^\s*import\s"))
    clause = F.regexp_extract("text", r"^\s*import\s+(?:type\s+)?(.*?)\s+from\s", 1)
    return lines.select(F.explode(F.regexp_extract_all(clause, F.lit(r"[A-Za-z_$][\w$]*"), 0)).alias("name")).where("name not in ('as', 'type')").distinct()


def block_findings(facts: DataFrame, most_complexity: int = 20, most_depth: int = 5) -> DataFrame:
    """Empty catches, and blocks that are too complex or too deeply nested: file, line, rule, severity, message, confidence.

    A block's own text is read again, as its numbers are those of the block alone.
    """
    catches = facts.select(F.col("path").alias("file"), F.explode("empty_catches").alias("line")).select(
        "file", "line", F.lit("empty-catch").alias("rule"), F.lit("warning").alias("severity"), F.lit("empty catch block").alias("message"), F.lit(0.95).alias("confidence"))
    rows = facts.where(F.col("language").isin(*LANG_FLAGS)).select(F.col("path").alias("file"), "language", F.inline("blocks"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, lang, name, kind, start, text in zip(pdf["file"], pdf["language"], pdf["name"], pdf["kind"], pdf["start_line"], pdf["source"]):
                f = script_facts(f"class _ {{\n{text}\n}}" if kind == "method" else text, lang)
                if f.complexity >= most_complexity:
                    out.append((file, start, "high-complexity", "warning", f"`{name}` has complexity {f.complexity}", 1.0))
                if f.max_nesting_depth >= most_depth:
                    out.append((file, start, "deep-nesting", "warning", f"`{name}` has nesting depth {f.max_nesting_depth}", 1.0))
            yield pd.DataFrame(out, columns=["file", "line", "rule", "severity", "message", "confidence"])

    return catches.unionByName(rows.select("file", "language", "name", "kind", "start_line", "source").mapInPandas(run, "file string, line bigint, rule string, severity string, message string, confidence double"))
