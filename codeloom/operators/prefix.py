"""Joins on "starts with", as equality joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_join(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str, how: str = "inner") -> DataFrame:
    """Rows joined with the prefixes that their ``text`` starts with; ``how`` is inner or left_semi.

    The beginnings of a text are cut at the lengths that prefixes have and met
    by equality, so neither side is broadcast and no pair is tried in vain. The
    driver reads the distinct lengths only, which are at most as many as the
    longest prefix has characters. Rows with a null text and null prefixes meet nothing.
    """
    known = prefixes.where(F.col(prefix).isNotNull())
    lengths = sorted(r[0] for r in known.select(F.length(prefix).alias("n")).distinct().collect())
    if not lengths:
        return rows.join(known, F.lit(False), how)
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(text))
    cut = rows.where(F.col(text).isNotNull()).withColumn("_begin", F.explode(fitting)).withColumn("_begin", F.substring(F.col(text), F.lit(1), F.col("_begin")))
    met = cut.join(known, cut["_begin"] == known[prefix], how).drop("_begin")
    return met.distinct() if how == "left_semi" else met
