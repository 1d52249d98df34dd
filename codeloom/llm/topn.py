"""The N leading rows of every group, by per-group score histograms.

Impacts go into buckets that follow their order: sixteen to each power of two.
Per group and bucket a safe lower bound of the number of different rows is
counted (one, or two where the smallest and largest id differ, so exact copies
never count). From the top down, the first bucket at which N are certain is the
group's threshold: no row below it can be among the N. Every group with more
than N rows has a threshold. Those of the largest groups, whose number has an
arithmetic bound, reach the scan by a broadcast, so their rows are dropped before
anything moves; those of the other groups meet their rows in the shuffle by group
that the exact rank needs anyway. Copies of a row are merged before that shuffle,
and the rank is pushed before it by Spark (WindowGroupLimit) where it can, so even
a group whose rows are all one row or all tie sends few rows from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.skew import heavy_from
from codeloom.session import materialize

BUCKETS_PER_POWER = 16
HEAVY_FLOOR = 10_000


def score_bucket(score: Column) -> Column:
    """A bigint that never falls where the score rises, for any double but NaN."""
    size = F.least(F.greatest(F.floor(F.log2(F.abs(score)) * BUCKETS_PER_POWER), F.lit(-20_000)), F.lit(20_000)).cast("bigint") + 40_000
    return F.when(F.isnan(score), None).when(score > 0, size).when(score < 0, -size).otherwise(F.lit(0).cast("bigint"))


def thresholds(rows: DataFrame, n: int) -> DataFrame:
    """grp, rows, least_bucket of the groups with more than ``n`` rows (grp, score, id) that ``n`` certain rows allow a threshold."""
    hist = rows.groupBy("grp", score_bucket(F.col("score")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"), F.when(F.min("id") == F.max("id"), 1).otherwise(2).alias("sure")
    )
    down = Window.partitionBy("grp").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hist.withColumn("upto", F.sum("sure").over(down))
        .groupBy("grp")
        .agg(F.sum("rows").alias("rows"), F.max(F.when(F.col("upto") >= n, F.col("bucket"))).alias("least_bucket"))
        .where((F.col("rows") > n) & F.col("least_bucket").isNotNull())
    )


def top_n(df: DataFrame, group: str, score: str, then: str, key: str, n: int = 3, heavy_floor: int = HEAVY_FLOOR) -> DataFrame:
    """The first ``n`` rows of every group: grp, id, rank.

    Order: ``score`` descending, ``then`` descending with null last, ``key``
    ascending. Rows with null group or key and rows with null or NaN score
    take no part. Exact copies count once; a group with fewer than ``n`` rows
    gives what it has; an empty table gives no rows. Other columns are ignored
    whatever their names.
    """
    rows = df.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{score}`").alias("score"), F.col(f"`{then}`").alias("tie"), F.col(f"`{key}`").alias("id"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    limits = materialize(thresholds(rows, n), "thresholds")
    heavy = limits.where(F.col("rows") >= heavy_from(df.count(), heavy_floor)).select("grp", F.col("least_bucket").alias("least"))
    above = lambda least: F.col(least).isNull() | (score_bucket(F.col("score")) >= F.col(least))
    kept = rows.join(F.broadcast(heavy), "grp", "left").where(above("least")).drop("least").distinct()
    kept = kept.join(limits.select("grp", "least_bucket"), "grp", "left").where(above("least_bucket"))
    order = Window.partitionBy("grp").orderBy(F.desc("score"), F.desc_nulls_last("tie"), F.asc("id"))
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("grp", "id", "rank")
