"""Files that nobody wrote by hand in the project: generated, minified, vendored, or data saved as code.

Notices are found with one automaton over the comments of a file's header.
A notice counts where the comment itself claims it for its own file: a phrase in
quotes is a mention, and one that its own sentence denies or puts into the past
is no claim. Path rules know the folders and suffixes of vendored and built
files. Minified text, record-by-record generated code and data blobs are known by
their shape. Last, a file that shares most of its lines with a known third-party
file of another place is a copy of it, also if patched: MinHash bands find the
candidates, and the whole sets of lines decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.neardup import band_keys
from codeloom.operators.pairs import bucket_cross
from codeloom.session import materialize

# Phrases by which tools and licences mark a file.
GENERATED = (
    "@generated", "<auto-generated", "autogenerated by", "auto-generated by", "automatically generated by", "code generated by", "file was generated", "file is generated", "file is automatically generated", "file has been automatically generated",
    "was generated automatically", "is generated automatically", "auto-generated file", "autogenerated file", "generated file - do not", "generated file, do not", "generated file. do not", "generated by the protocol", "generated code -- do not", "do not edit this file", "do not edit by hand", "do not edit manually", "do not modify by hand",
    "edits are overwritten", "edits will be overwritten", "changes are overwritten", "changes will be overwritten", "changes will be lost", "changes are lost", "this is a generated file", "machine generated",
)
VENDORED = (
    "released under the mit", "released under the bsd", "released under the apache", "licensed under mit", "licensed under the mit", "licensed under apache", "licensed under the apache", "bsd licensed", "mit licensed", "| mit", "| bsd", "| apache", "mit or apache-2.0", "apache-2.0 or mit",
    "@license", "@licence", "(c) the ", "license: mit", "license: bsd", "spdx-license-identifier",
)
# Folders and names of vendored or built files.
VENDOR_DIRS = r"(?:vendor|third_party|third-party|thirdparty|node_modules|bower_components|external|externals|deps|libs|jspm_packages|site-packages|_vendor|Pods|Carthage)"
BUILD_DIRS = r"(?:__generated__|_generated_|generated|gen|dist)"
LOCKFILES = r"(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Cargo\.lock|poetry\.lock|composer\.lock|Gemfile\.lock|npm-shrinkwrap\.json)"
NAME_SUFFIX = r"(?:\.min|\.bundle|\.chunk|\.prod|\.umd|\.iife|-min|_pb2|_pb2_grpc|_pb|\.pb|\.pb\.\w+|\.g|\.gen|\.generated|\.freezed)\.\w+"

DIR_RULE = re.compile(rf"(?:^|/){VENDOR_DIRS}/")
BUILD_RULE = re.compile(rf"(?:^|/){BUILD_DIRS}/|(?:^|/)proto/out/|(?:^|/)(?:public|static)/assets/")
NAME_RULE = re.compile(rf"(?:^|/)(?:{LOCKFILES}|[^/]*{NAME_SUFFIX})$")
HASHED_NAME = re.compile(r"[-.][0-9a-f]{8,32}\.(?:js|mjs|cjs|css)$")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in (("generated", GENERATED), ("vendored", VENDORED)):
        for p in phrases:
            a.add_word(p, (kind, len(p)))
    a.make_automaton()
    return a


NOTICES = _automaton()
STRICT = re.compile(r"(?:'use strict'|\"use strict\")\s*;?")


def header(source: str) -> tuple[list[str], str]:
    """(the comments before the first code, one string per comment or comment line; the text from the first code on)."""
    found: list[str] = []
    at = 0
    source = source.lstrip("\ufeff")
    while at < len(source):
        end = source.find("\n", at)
        end = len(source) if end < 0 else end
        text = source[at:end].strip()
        if text.startswith("/*"):
            start = source.index("/*", at)
            close = source.find("*/", start + 2)
            close = len(source) if close < 0 else close + 2
            found.append("\n".join(x.strip() for x in source[start:close].split("\n")))
            at = close
        elif text.startswith(("//", "#")) and not text.startswith(("#!", "#[")):
            found.append(text)
            at = end + 1
        elif text.startswith("#!") or not text:
            at = end + 1
        elif strict := STRICT.match(text):
            at = source.index(strict[0], at) + len(strict[0])
        else:
            break
    return found, source[at:]


QUOTED = re.compile(r"\"[^\"\n]*\"|`[^`\n]*`|(?<!\w)'[^'\n]*'(?!\w)|“[^”\n]*”")
SENTENCE = re.compile(r"[.;!?:](?=\s|$)|\n\s*\n|\n(?=[\s*#/]*[@A-Z])")
DENIED = re.compile(r"\b(?:not|never|no longer|once|formerly|originally|isn't|wasn't|aren't)\b")


def header_claims(comments: list[str]) -> set[str]:
    """The kinds of notice that the comments claim: phrases outside quotes with no denial before them in their sentence."""
    claims: set[str] = set()
    for comment in comments:
        bare = QUOTED.sub(lambda m: " " * len(m[0]), comment)
        text = bare.lower()
        if len(text) != len(bare):
            text = "".join(c if len(c.lower()) != 1 else c.lower() for c in bare)
        for end, (kind, size) in NOTICES.iter(text):
            begin = end + 1 - size
            sentence = max((m.end() for m in SENTENCE.finditer(bare, 0, begin)), default=0)
            if not DENIED.search(text, sentence, begin):
                claims.add(kind)
    return claims


STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
REGEX_LINE = re.compile(r"=\s*/(?:[^/\\\n]|\\.)+/[a-z]*\s*;?\s*$", re.M)
BLOCK_COMMENT = re.compile(r"/\*.*?\*/", re.S)
WORDS = re.compile(r"[A-Za-z_$][\w$]*")
DIGITS = re.compile(r"\d+(?:\.\d+)?")


def looks_minified(source: str) -> bool:
    """Long lines of code with short names and hardly any blanks; long strings, regular expressions and data lines are not code."""
    body = REGEX_LINE.sub("=0", STRING.sub('""', BLOCK_COMMENT.sub("", source)))
    lines = [x for x in body.split("\n") if x.strip() and not x.lstrip().startswith("//")]
    size = sum(map(len, lines))
    wide = [x for x in lines if len(x) > 180]
    code = sum(len(x) for x in wide)
    if not code or code < 0.6 * size:
        return False
    joined = "\n".join(wide)
    blanks = sum(joined.count(c) for c in " \t") / len(joined)
    marks = sum(joined.count(c) for c in "(){};") / len(joined)
    return blanks < 0.12 and marks > 0.06


def looks_like_data(source: str) -> bool:
    """Almost all of the text are literals of one or a few collections, and there is no control flow or function."""
    text = BLOCK_COMMENT.sub("", source)
    text = "\n".join(x for x in text.split("\n") if not re.match(r"\s*(?://|#(?!\[))", x))
    strings = STRING.findall(text)
    bare = STRING.sub("", text)
    if re.search(r"\b(?:function|def|fn|class|if|for|while|return|impl|struct|import|use|lambda)\b|=>", bare):
        return False
    numbers = sum(len(x) for x in DIGITS.findall(bare))
    literal = sum(map(len, strings)) + numbers + sum(bare.count(c) for c in "[]{}(),:-. \n\t")
    return literal > 0.85 * len(text)


RUN = 8  # consecutive numbers that make a running number


def looks_recorded(source: str) -> bool:
    """Hardly anything but declarations that differ in names, literals and a running number."""
    lines = [x.strip() for x in source.split("\n")]
    lines = [x for x in lines if x and not x.startswith(("//", "#", "*", "/*"))]
    by_shape: dict[str, list[str]] = {}
    for x in lines:
        by_shape.setdefault(DIGITS.sub("0", WORDS.sub("a", STRING.sub('""', x))), []).append(x)
    top = sorted(by_shape.values(), key=len, reverse=True)[:4]
    if sum(map(len, top)) < 0.9 * len(lines):
        return False
    for same in top:
        if len(same) < RUN:
            continue
        fields = [re.findall(r"\d+", x) for x in same]
        for i in range(min(map(len, fields))):
            values = [int(f[i]) for f in fields]
            if sum(y - x == 1 for x, y in zip(values, values[1:])) >= 0.8 * (len(values) - 1):
                return True
    return False


WRAPPER = re.compile(r"\(\s*function\s*\(\s*root\s*,\s*factory\s*\)|typeof\s+(?:module|exports)\s*===?\s*['\"]object['\"]|typeof\s+define\s*===?\s*['\"]function['\"]")


MODULE = re.compile(r"^(?:import|export)\b", re.M)  # wrappers are no ES modules


def classify(path: str, source: str) -> str | None:
    """generated, minified, vendored or data by the file itself; None if nothing marks it."""
    comments, code = header(source)
    claims = header_claims(comments)
    if NAME_RULE.search(path):
        return "minified" if re.search(r"[.-](?:min|bundle|chunk|prod|umd|iife)\.", path) else "generated"
    if "generated" in claims or looks_recorded(source):
        return "generated"
    if looks_minified(source) or (HASHED_NAME.search(path) and max(map(len, source.split("\n"))) > 200):
        return "minified"
    if looks_like_data(source):
        return "data"
    if "vendored" in claims or DIR_RULE.search(path) or (WRAPPER.search(code) and not MODULE.search(code)):
        return "vendored"
    if BUILD_RULE.search(path):
        return "generated"
    return None


# Copies of third-party files: MinHash bands of the sets of lines. A copy that shares half of all lines is a candidate with a chance of 0.99.
ROWS, BANDS = 2, 16


def line_set(source: str) -> np.ndarray:
    """The different lines without the white space around them, as sorted 64-bit hashes; blank lines are left out."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(t) for t in {x.strip() for x in source.split("\n")} if t], np.uint64))


FACTS = "path string, kind string, bands array<bigint>, lines array<bigint>, id binary"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, bands, sets, ids = [], [], [], []
        for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            kind = classify(path, source)
            lines = line_set(source) if kind in (None, "vendored") else np.empty(0, np.uint64)
            kinds.append(kind)
            bands.append(band_keys(lines, ROWS, BANDS).view(np.int64) if len(lines) else None)
            sets.append(lines.view(np.int64) if len(lines) else None)
            ids.append(xxhash.xxh3_128_digest(lines.tobytes()) if len(lines) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64())), pa.array(ids, pa.binary())], ["path", "kind", "bands", "lines", "id"])


def classify_files(files: DataFrame, copied: float = 0.5) -> DataFrame:
    """path, kind: one row per file with the kind generated, minified, vendored or data, or null for hand-written source.

    A file without marks is vendored too if at least ``copied`` of the lines of
    both together are shared with a file that is known to be vendored. Files
    with null path or source are left out, an empty source is hand-written,
    exact copies of a row count once; a path with several texts takes the first
    kind by name. Texts are read whole. An empty table gives no rows.
    """
    rows = files.select("path", "source").where(F.col("path").isNotNull() & F.col("source").isNotNull())
    facts = materialize(rows.mapInArrow(_facts, FACTS), "source-facts")
    sets = facts.where("id is not null")
    keys = lambda kept: sets.where(kept).select(F.explode("bands").alias("bucket"), "id").distinct()  # noqa: E731  # equal sets are one
    met = bucket_cross(keys("kind is null"), keys("kind is not null"), sets.count() * BANDS)
    mine = sets.where("kind is null").select(F.col("id").alias("a"), F.col("lines").alias("la")).dropDuplicates(["a"])
    theirs = sets.where("kind is not null").select(F.col("id").alias("b"), F.col("lines").alias("lb")).dropDuplicates(["b"])
    shared = F.size(F.array_intersect("la", "lb"))
    close = met.join(theirs.hint("merge"), "b").join(mine.hint("merge"), "a").where(shared >= copied * (F.size("la") + F.size("lb") - shared)).select(F.col("a").alias("id")).distinct()
    copies = sets.where("kind is null").join(close, "id", "left_semi").select("path").distinct()
    marked = copies.select("path", F.lit("vendored").alias("copy"))
    return facts.groupBy("path").agg(F.min("kind").alias("kind")).join(marked, "path", "left").select("path", F.coalesce("kind", "copy").alias("kind"))


def not_handwritten(files: DataFrame) -> DataFrame:
    return classify_files(files).where(F.col("kind").isNotNull())


def handwritten(files: DataFrame) -> DataFrame:
    """The hand-written files only, with all their columns."""
    return files.join(classify_files(files).where("kind is null").select("path"), "path", "left_semi")
