"""Text cut off by field limits or broken transfers.

A field limit shows as a length at which many texts of a source end. For every
source and unit (characters and UTF-8 bytes) the discrete hazard of each length
is tested against the hazard of the lengths around it, and the false discovery
rate over all tests is controlled. How a text ends is read from its last line.
An ending inside a word, sentence or markup element is proof enough at any
length, as a broken transfer has no fixed one; an ending that may be either, such
as an ellipsis or an item of a list whose items have no full stops, counts at a
significant length only. A text that stops without a full stop is whole if it
ends with a line that closes many texts, as a log is with a line that closes many logs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialize

NEIGHBOURS = 25
FALSE_RATE = 0.01
P_STEPS = 64  # steps of a power of two in the table of p-values

COMPLETE, INCOMPLETE, OPEN, EITHER, LOG = "complete", "incomplete", "open", "either", "log"

# A sentence end, perhaps inside quotes, brackets or emphasis.
SENTENCE_END = re.compile(r"[.!?。！？]+[\"'”’»)\]*_`]*$")
ELLIPSIS = re.compile(r"(?:\.\.\.|…)[\"'”’»)\]*_`]*$")
CUT_MARKUP = re.compile(r"(?:<[A-Za-z/!][^<>]*|&#?\w{1,8}|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|\[[^\]]*\]\([^)]*|!?\[[^\]]*|https?:/*)$")
# Last lines that end a text without a full stop.
CLOSING_LINE = re.compile(
    r"(?:--\s*\S.*|[—–-]\s+[A-Z@].*|\(.*\)|(?:fix(?:es|ed)?|close[sd]?|resolve[sd]?|refs?|see|issue|bug|part of|relates to):?\s+[\w/.-]*#\d+(?:,\s*#\d+)*"
    r"|(?:see|siehe|véase|cf\.?)\s+\S*[\w)]\.\w{1,5}|(?:none|n/a|tbd|todo|done|thanks|danke|gracias|lgtm|keine|ninguno|ninguna)|[-*_=]{3,}|\|.*\||<[^<>]+>|https?://\S+|[\w-]+-by:\s.*>|`[^`]+`|\*\*[^*]+\*\*)",
    re.I,
)
BULLET = re.compile(r"(?:[-*+•]|\d{1,3}[.)])\s+(?:\[[ xX]\]\s+)?")
QUOTE = re.compile(r"(?:[>|]\s?)+")

MASK = re.compile(r"[\w.-]*/[\w./-]+|\b[A-Za-z]+(?:[A-Z][a-z0-9]+)+\b|\b\w+(?:_\w+)+\b|\d+(?:\.\d+)*")


EXTENSION = re.compile(r"\w\.\w{1,5}$")


def shape(line: str) -> str:
    """The line without names, paths and numbers; paths with and without an extension differ."""
    return MASK.sub(lambda m: "0" if "/" not in m[0] else "/." if EXTENSION.search(m[0]) else "/", line)


def looks_like_log(lines: list[str]) -> bool:
    """Four or more lines without blank ones between them, hardly any of which before the last ends as a sentence, and no lists or headings."""
    if len(lines) < 4 or any(not x.strip() for x in lines[:-1]):
        return False
    body = lines[:-1]
    marked = sum(x.lstrip().startswith(("- ", "* ", "#", ">", "|", "```")) for x in body)
    ends = sum(bool(SENTENCE_END.search(x.rstrip())) or x.rstrip().endswith(",") for x in body)
    return marked + ends <= 0.2 * len(body)


def bare_items(lines: list[str]) -> bool:
    """Whether the lines end with list items, and most of these have no full stop."""
    items: list[str] = []
    for x in reversed(lines):
        if not BULLET.match(x.strip()):
            break
        items.append(x.strip())
    return 2 * sum(bool(SENTENCE_END.search(x)) for x in items) < len(items)


def ending(text: str) -> tuple[str, str]:
    """(class, shape of the last line) of how the text ends."""
    whole = text.rstrip()
    if not whole:
        return COMPLETE, ""
    lines = whole.split("\n")
    last = QUOTE.sub("", lines[-1].strip(), count=1) if lines[-1].lstrip().startswith((">", "|")) and not lines[-1].rstrip().endswith("|") else lines[-1].strip()
    if not last:
        return INCOMPLETE, ""
    if last[-1] == "�" or CUT_MARKUP.search(last):
        return INCOMPLETE, shape(last)
    fences = sum(x.lstrip().startswith("```") for x in lines)
    if fences % 2:
        return INCOMPLETE, shape(last)
    if last.startswith("```"):
        return COMPLETE, shape(last)
    if looks_like_log(lines):
        return LOG, shape(last)
    if ELLIPSIS.search(last):
        return EITHER, shape(last)
    item = BULLET.match(last)
    body = last[item.end() :] if item else last
    if body.count("`") % 2:
        return INCOMPLETE, shape(last)
    if SENTENCE_END.search(body):
        return COMPLETE, shape(last)
    if item:
        return (EITHER if bare_items(lines[:-1]) and body[-1:].isalnum() else INCOMPLETE), shape(last)
    if CLOSING_LINE.fullmatch(body):
        return COMPLETE, shape(last)
    return OPEN, shape(last)


def source_name(col):
    """One spelling for each source: lower case, blanks and hyphens as underscores; null stays null."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[-_\s]+", "_")


FACTS = "doc_id bigint, source string, chars int, bytes int, ending string, shape string, digest bigint"


def text_facts(documents: DataFrame) -> DataFrame:
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", source_name(F.col("source")).alias("source"), "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            ends = [ending(t) for t in texts]
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(map(len, texts), pa.int32()), pa.array(map(len, raw), pa.int32()), pa.array([e[0] for e in ends]), pa.array([e[1] for e in ends]), pa.array([xxhash.xxh3_64_intdigest(r) - (1 << 63) for r in raw], pa.int64())],
                ["doc_id", "source", "chars", "bytes", "ending", "shape", "digest"],
            )

    return rows.mapInArrow(read, FACTS)


def significant_lengths(facts: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """source, unit, length, texts, at_risk, expected of the lengths whose hazard stands out.

    The hazard of a length is the share that ends there of the texts that
    reach it; each text counts once whatever its copies. The chance of the
    count, given the hazard of the NEIGHBOURS lengths on either side (with half
    a text added), is bounded by Chernoff's bound, and Benjamini and Hochberg's
    rule keeps the expected share of false finds below ``rate``. Windows run
    over distinct lengths of a source, not over texts.
    """
    once = facts.where(F.col("source").isNotNull()).select("source", "chars", "bytes", "digest").distinct()
    units = once.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("u")).select("source", "u.*")
    counts = units.groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("texts"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    reach = by.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    near = by.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    tested = counts.withColumn("at_risk", F.sum("texts").over(reach))
    around = F.sum("texts").over(near) - F.col("texts")
    # a length without texts has the at-risk count of the next length that has some, which is close enough for a rate
    base = F.max("at_risk").over(near) * F.lit(2 * NEIGHBOURS)
    tested = tested.withColumn("expected", (around + 0.5) / base * F.col("at_risk"))
    n, e = F.col("texts"), F.col("expected")
    tested = tested.withColumn("log_p", F.when(n > e, -(n * F.log(n / e) - n + e)).otherwise(F.lit(0.0)))
    total = tested.agg(F.count(F.lit(1)).alias("tests"))
    small = tested.where(F.col("log_p") <= F.log(F.lit(rate)))
    # ranks of the p-values: a table of steps, whose number has a bound whatever the number of tests, then ranks inside a step
    small = small.withColumn("step", F.floor(F.log2(-F.col("log_p")) * P_STEPS))
    steps = small.groupBy("step").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy(F.desc("step"))) - F.col("n"))
    ranked = small.join(F.broadcast(steps.select("step", "before")), "step").crossJoin(F.broadcast(total))
    ranked = ranked.withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("step").orderBy("log_p")))
    held = ranked.where(F.col("log_p") <= F.log(F.lit(rate) * F.col("k") / F.col("tests"))).agg(F.max("k").alias("last"))
    return ranked.crossJoin(F.broadcast(held)).where(F.col("k") <= F.col("last")).select("source", "unit", "length", "texts", "at_risk", "expected")


def closing_shapes(facts: DataFrame, share: float = 0.02, least: int = 2) -> DataFrame:
    """shape of the last lines that close at least ``share`` of all logs, or of all texts that stop without a full stop."""
    ends = facts.where(F.col("ending").isin(LOG, OPEN)).select("ending", "shape", "digest").distinct()
    total = ends.groupBy("ending").agg(F.count(F.lit(1)).alias("all"))
    counts = ends.groupBy("ending", "shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.join(F.broadcast(total), "ending").where(F.col("n") >= share * F.col("all")).select("shape").distinct()


def judged(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per document and text: doc_id, source, truncated, at_limit; the significant lengths).

    Documents with null id or text are left out, an empty text is complete,
    repeated rows count once, and texts without a source are held against the
    significant lengths of all sources. Texts are read whole.
    """
    facts = materialize(text_facts(documents).distinct(), "text-facts")
    limits = materialize(significant_lengths(facts), "limits")
    at = limits.select(F.col("source").alias("s"), "unit", "length").distinct()
    chars = at.where("unit = 'chars'").select("s", F.col("length").alias("chars"), F.lit(True).alias("by_chars"))
    byts = at.where("unit = 'bytes'").select("s", F.col("length").alias("bytes"), F.lit(True).alias("by_bytes"))
    anyc = chars.select(F.lit("").alias("s"), "chars", "by_chars").distinct()
    anyb = byts.select(F.lit("").alias("s"), "bytes", "by_bytes").distinct()
    keyed = facts.withColumn("s", F.coalesce("source", F.lit("")))
    keyed = keyed.join(chars.union(anyc), ["s", "chars"], "left").join(byts.union(anyb), ["s", "bytes"], "left")
    keyed = keyed.join(F.broadcast(closing_shapes(facts).withColumn("closes", F.lit(True))), "shape", "left")  # at most 1 / share shapes of each class
    at_limit = F.coalesce("by_chars", "by_bytes", F.lit(False))
    cut = (F.col("ending") == INCOMPLETE) | (F.col("ending").isin(OPEN, LOG) & F.col("closes").isNull()) | ((F.col("ending") == EITHER) & at_limit)
    return keyed.select("doc_id", "source", cut.alias("truncated"), at_limit.alias("at_limit")), limits


def truncated_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the documents whose text was cut off."""
    return judged(documents)[0].where("truncated").select("doc_id").distinct()


def truncation_rates(documents: DataFrame) -> DataFrame:
    """source, documents, truncated, at_limit, rate: how often each source truncates, and how many of these texts end at a significant length."""
    rows = judged(documents)[0]
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("truncated").cast("bigint")).alias("truncated"), F.sum((F.col("truncated") & F.col("at_limit")).cast("bigint")).alias("at_limit")
    ).withColumn("rate", F.round(F.col("truncated") / F.col("documents"), 6))
