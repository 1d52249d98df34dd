"""Pairs of rows that share a bucket, without a task that holds a whole large bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import join_per_key

CHUNK = 400


def bucket_pairs(members: DataFrame, total: int, chunk: int = CHUNK, heavy_floor: int = 200_000, keep: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(bucket, id) → distinct pairs (a, b), a < b, of ids that share a bucket; ``total`` is the number of rows.

    ``keep`` (a, b) leaves out pairs that can't count before they are shuffled.

    Buckets of up to ``chunk`` ids are paired in place. Larger ones are cut
    into chunks by id, and each pair of chunks is its own group of about
    2 · chunk ids, whatever the size of the bucket.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    # two joins, so that the one for large buckets costs nothing where there are none
    lists = members.join(sizes.where("parts = 1").select("bucket"), "bucket").groupBy("bucket").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    inner = F.flatten(F.transform("ids", lambda a, i: F.transform(F.slice("ids", i + 2, F.size("ids")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    near = lists.select(F.explode(inner).alias("p")).select("p.a", "p.b")
    near = near.where(keep(F.col("a"), F.col("b"))) if keep else near
    far = _grid(join_per_key(members, sizes.where("parts > 1"), "bucket", "n", total, heavy_floor)).select("a", "b")
    far = far.where(keep(F.col("a"), F.col("b"))) if keep else far
    return near.union(far).distinct()


def _grid(cut: DataFrame) -> DataFrame:
    """(bucket, id, parts) → (bucket, a, b), a < b: the pairs of each pair of chunks."""
    cut = cut.withColumn("c", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    left = cut.select("bucket", "c", F.explode(F.sequence("c", F.col("parts") - 1)).alias("d"), F.col("id").alias("x"))
    right = cut.select("bucket", F.explode(F.sequence(F.lit(0), F.col("c"))).alias("c"), F.col("c").alias("d"), F.col("id").alias("y"))
    met = left.join(right, ["bucket", "c", "d"]).where((F.col("c") < F.col("d")) | (F.col("x") < F.col("y"))).where("x <> y")
    return met.select("bucket", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def pairs_by_bucket(members: DataFrame, total: int, chunk: int = CHUNK, heavy_floor: int = 200_000) -> DataFrame:
    """(bucket, id), distinct → (bucket, a, b), a < b: each pair once for each bucket it shares, made chunk by chunk."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / chunk).cast("int"))
    return _grid(join_per_key(members, sizes, "bucket", "n", total, heavy_floor))


def bucket_cross(left: DataFrame, right: DataFrame, total: int, chunk: int = CHUNK, heavy_floor: int = 200_000) -> DataFrame:
    """(bucket, id) twice → distinct pairs (a, b) of an id of ``left`` and one of ``right`` that share a bucket; ``total`` is the number of rows of both.

    Both sides of a bucket are cut into chunks by id, and each pair of chunks is its own group.
    """
    count = lambda d, n: d.groupBy("bucket").agg(F.count(F.lit(1)).alias(n))
    parts = lambda n: F.ceil(F.col(n) / chunk).cast("int")
    sizes = count(left, "n").join(count(right, "m"), "bucket").select("bucket", "n", "m", parts("n").alias("rows"), parts("m").alias("cols"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    x = join_per_key(left, sizes.drop("m"), "bucket", "n", total, heavy_floor).select("bucket", part("rows").alias("c"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("d"), F.col("id").alias("a"))
    y = join_per_key(right, sizes.drop("n"), "bucket", "m", total, heavy_floor).select("bucket", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("c"), part("cols").alias("d"), F.col("id").alias("b"))
    return x.join(y, ["bucket", "c", "d"]).select("a", "b").distinct()
