"""Scalar functions over source text, paths and specifiers, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def trim_all(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def text_lines(c: Column) -> Column:
    """The lines of a text: no empty line after a last line end, and no carriage return before a line end."""
    parts = F.split(c, "\r?\n", -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))).otherwise(parts)


def count_loc(source: Column) -> tuple[Column, Column]:
    """(loc, total): lines that are neither blank nor start with ``//``, and all lines."""
    lines = text_lines(source)
    code = F.filter(lines, lambda x: ~trim_all(x).rlike("^(//|$)"))
    return F.size(code).cast("bigint"), F.size(lines).cast("bigint")


def is_internal(spec: Column) -> Column:
    """A specifier that starts with ``.``, ``/``, ``@/``, ``~`` or ``#``."""
    return spec.rlike(r"^(\.|/|@/|~|#)")


def is_unresolved(spec: Column) -> Column:
    return spec.rlike(r"^(\./|\.\./|@/|~/|#)")


def package_name(spec: Column) -> Column:
    """The package of an external specifier: two segments if scoped, else one; a bare ``@`` gives the empty string."""
    return F.when(spec == "@", F.lit("")).when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"^(['\"`])([\s\S]*)\1$", "$2")


def normalized(source: Column) -> Column:
    """Without comments, white space collapsed, ASCII lower case, trimmed; comments inside strings are comments too."""
    bare = F.regexp_replace(F.regexp_replace(source, r"/\*[\s\S]*?(?:\*/|$)|//[^\n]*", " "), r"(?U)\s+", " ")
    return F.trim(ascii_lower(bare))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda x: x != "")


PATTERN_TOKEN = r"""[\p{L}\p{N}_]+!?|"(?:[^"\\]|\\[\s\S])*+"?|'(?:[^'\\]|\\[\s\S])*+'?|===|!==|\.\.\.|->|=>|::|==|!=|&&|\|\||\?\?|<=|>=|\.\.|\S"""


def pattern_tokens(source: Column) -> Column:
    """Identifiers (with a following ``!``), whole strings, three- and two-character operators, single characters."""
    return F.regexp_extract_all(source, F.lit(PATTERN_TOKEN), 0)


def truncate_bytes(c: Column, most: int, keep: int) -> Column:
    """At most ``most`` UTF-8 bytes; longer text keeps what fits in ``keep`` bytes, whole characters only, and an ellipsis."""

    def cut(x: Column) -> Column:
        sizes = F.transform(F.sequence(F.lit(1), F.lit(keep)), lambda i: F.octet_length(F.substring(x, F.lit(1), i)))
        fit = F.size(F.filter(sizes, lambda n: n <= keep))
        return F.when(F.octet_length(x) > most, F.concat(F.substring(x, F.lit(1), fit), F.lit("..."))).otherwise(x)

    return let(c, cut)


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_to(path: Column, root: str) -> Column:
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1_000_000)).otherwise(path)


def normalize_entry(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\./)+", "")


def round2(x: Column) -> Column:
    return F.round(x * 100) / 100


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def guard_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets kept as arrays, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def markdown_escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([|`*_<>\[\]])", r"\\$1"), r"[\r\n]+", " ")


def markdown_cell(c: Column) -> Column:
    """Text for a cell of a table."""
    for a, b in (("|", "\\|"), ("[", "\\["), ("]", "\\]"), ("`", "\\`"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"[\r\n]", " ")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1B(?:\[[0-?]*[ -/]*[@-~]|\][^\x07]*\x07|[@-Z\\-_])", "")


def mermaid_label(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, '"', "#quot;"), r"[\r\n]+", " ")


def mermaid_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")


def shell_quote(c: Column) -> Column:
    return F.concat(F.lit("'"), F.regexp_replace(c, "'", r"'\\''"), F.lit("'"))


def common_prefix_dir(paths: Column) -> Column:
    """The longest directory prefix shared by an array of paths, empty if there is none."""
    lo, hi = F.split(F.array_min(paths), "/"), F.split(F.array_max(paths), "/")
    n = F.least(F.size(lo), F.size(hi)) - 1
    upto = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("k"), F.lit(True).alias("open")),
        lambda acc, i: F.struct(F.when(acc["open"] & (F.element_at(lo, i) == F.element_at(hi, i)), i).otherwise(acc["k"]).alias("k"), (acc["open"] & (F.element_at(lo, i) == F.element_at(hi, i))).alias("open")),
    )["k"]
    return F.when(upto > 0, F.concat(F.array_join(F.slice(lo, 1, upto), "/"), F.lit("/"))).otherwise(F.lit(""))
