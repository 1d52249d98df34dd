"""Queries of the operators of this subpackage over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.groups import linked_groups
from codeloom.llm.handwritten import classify_files, not_handwritten
from codeloom.llm.leak import leaked_items, leaked_passages, without_leaks
from codeloom.llm.mixing import mix
from codeloom.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from codeloom.llm.spans import fuzzy_passages, shared_share, shared_spans
from codeloom.llm.syntax import error_rates, invalid_files
from codeloom.llm.topn import top_n
from codeloom.llm.truncation import judged, truncated_documents, truncation_rates
from codeloom.plans.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    issues = table(spark, d, "ai_issues").select("file", "impact", "confidence", "issue_id")
    return top_n(issues, "file", "impact", "confidence", "issue_id", 3).select(F.col("grp").alias("file"), F.col("id").alias("issue_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return invalid_files(table(spark, d, "files")).select("path").distinct()


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    return invalid_files(table(spark, d, "files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return error_rates(table(spark, d, "files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "files")).select("path")


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    return classify_files(table(spark, d, "files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_groups(table(spark, d, "ncd_candidates"), 0.4)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated_documents(table(spark, d, "documents"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(table(spark, d, "documents"))


def p10_limits(spark: SparkSession, d: str) -> DataFrame:
    return judged(table(spark, d, "documents"))[1]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "blocks")).select("block_id", "first_line", "last_line")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_share(table(spark, d, "blocks"))


def p2_passages(spark: SparkSession, d: str) -> DataFrame:
    return fuzzy_passages(table(spark, d, "blocks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, d, "blocks"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_groups(table(spark, d, "blocks"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d).select("doc_id", "item_id", "words")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(_hits(spark, d))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return without_leaks(table(spark, d, "documents"), _hits(spark, d)).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_shares, p2_passages, p3_found, p4_found, p4_errors, p4_rates, p5_found, p5_kinds, p6_found, p7_found, p7_groups, p8_found, p8_passages, p8_items, p8_clean, p9_mix, p9_shares, p10_found, p10_rates, p10_limits)}
