"""Source files that do not parse, found with table-driven parsers over whole token streams.

The tables of the bundled grammars are made once on the driver and broadcast
(their size depends on the grammars only). Every file is parsed to its end or
to the first token that no stack can take and no supplied statement end can
repair; that token is the file's first unrecoverable error.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.lexers import js_chunks, py_chunks, rs_chunks
from codeloom.llm.grammars import ecma, python, rust
from codeloom.llm.lr import EOF, Recognizer, Tables, read_grammar

FLAGS = {"typescript": {"ts", "cast"}, "tsx": {"ts", "jsx"}, "javascript": set(), "jsx": {"jsx"}}
LANGUAGES = (*FLAGS, "python", "rust")

_tables: dict[str, Tables] = {}
_parsers: dict[str, Recognizer] = {}


def tables_for(language: str) -> Tables:
    if language not in _tables:
        text = {"python": python.GRAMMAR, "rust": rust.GRAMMAR}.get(language, ecma.GRAMMAR)
        _tables[language] = Tables(*read_grammar(text, FLAGS.get(language, set())))
    return _tables[language]


def chunks(language: str, source: str):
    if language == "python":
        return py_chunks(source)
    if language == "rust":
        return rs_chunks(source)
    flags = FLAGS[language]
    return js_chunks(source, "ts" in flags, "jsx" in flags)


def parser_for(language: str, tables: Tables | None = None) -> Recognizer:
    """One parser for each worker and language, so that what it remembers serves all files."""
    if language not in _parsers:
        _parsers[language] = Recognizer(tables or tables_for(language), "ASI" if language in FLAGS else None)
    return _parsers[language]


def first_error(language: str, source: str, tables: Tables | None = None) -> tuple[int, str] | None:
    """(line, token) of the first unrecoverable error, None for a valid file."""
    parser, line = parser_for(language, tables), 1
    stacks = parser.start()
    for line, terms in chunks(language, source):
        stacks, bad = parser.feed(stacks, terms)
        if bad >= 0:
            return line, terms[bad].lstrip("\n")
    return None if parser.finish(stacks) else (line, EOF)


ERRORS = "path string, repo string, language string, line int, token string"


def check_files(files: DataFrame) -> DataFrame:
    """One row for each readable file of a known language: path, repo, language, line and token of its first error, null if valid.

    Exact copies of a row count once. Files with null path or source are left
    out, and so are languages without a grammar; an empty source is valid. A
    leading byte order mark and any line ends are accepted. Texts are parsed
    whole whatever their length. An empty table gives no rows.
    """
    shared = files.sparkSession.sparkContext.broadcast({x: tables_for(x) for x in LANGUAGES})
    language = F.lower(F.trim("language"))
    rows = files.select("path", "repo", language.alias("language"), "source").where(F.col("path").isNotNull() & F.col("source").isNotNull() & F.col("language").isin(*LANGUAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, tokens = [], []
            for lang, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                e = first_error(lang, text, shared.value[lang])
                lines.append(e and e[0])
                tokens.append(e and e[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lines, pa.int32()), pa.array(tokens, pa.string())], ["path", "repo", "language", "line", "token"])

    return rows.mapInArrow(run, ERRORS).distinct()


def invalid_files(files: DataFrame) -> DataFrame:
    return check_files(files).where(F.col("line").isNotNull())


def error_rates(files: DataFrame) -> DataFrame:
    """repo, language, files, invalid, rate. A path with several texts is invalid if one of them is."""
    one = check_files(files).groupBy("repo", "language", "path").agg(F.max(F.col("line").isNotNull().cast("int")).alias("bad"))
    return one.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("bad").alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
