"""One group identifier for all records that are linked, by hash-to-min.

Every vertex keeps a cluster: itself and its neighbours. In each round it sends
the whole cluster to the cluster's smallest member and that member to all
others, until nothing changes. Clusters are kept as rows (vertex, member),
never as one value, so a giant component is spread over all tasks. Vertices are
numbered in byte order of their names, so rounds move pairs of integers and the
smallest number is the smallest name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.functions.paths import location
from codeloom.operators.skew import join_per_key
from codeloom.session import drop_path, shared_dir


def number_in_order(names: DataFrame, path: str) -> DataFrame:
    """(name, id) with ids in byte order of the names; written, as the ids must not change when a task is repeated."""
    ranged = names.distinct().repartitionByRange("name").sortWithinPartitions("name")
    ranged.select("name", F.monotonically_increasing_id().alias("id")).write.parquet(path)
    return names.sparkSession.read.schema("name string, id bigint").parquet(path)


def hash_to_min(edges: DataFrame, heavy_floor: int = 200_000, most_rounds: int = 64) -> DataFrame:
    """Edges (a, b) of names → (name, group): the smallest name reachable.

    Nulls and edges from a name to itself are ignored, repeats and direction
    do not matter, and an empty table gives an empty result. Raises if it has
    not settled after ``most_rounds`` rounds (a path of 2^40 vertices settles in fewer).
    """
    spark = edges.sparkSession
    root = shared_dir(spark, "hash-to-min")
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b")
    links.distinct().write.parquet(f"{root}/links")
    links = spark.read.schema("a string, b string").parquet(f"{root}/links")
    ids = number_in_order(links.select(F.col("a").alias("name")).union(links.select("b")), f"{root}/ids")
    first = (
        links.join(ids.select(F.col("name").alias("a"), F.col("id").alias("v")), "a")
        .join(ids.select(F.col("name").alias("b"), F.col("id").alias("u")), "b")
        .select("v", "u")
    )
    members = first.union(first.select("u", "v")).distinct()
    before = None
    for n in range(most_rounds):
        seen = Observation()
        path = f"{root}/round{n:03d}"
        members.observe(seen, F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("v", "u")).alias("xor"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("sum")).write.parquet(path)
        members = spark.read.schema("v bigint, u bigint").parquet(path)
        if n:
            drop_path(spark, f"{root}/round{n - 1:03d}")
        now = seen.get
        if now == before or not now["rows"]:
            break
        before = now
        least = members.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("held")).withColumn("m", F.least("v", "m"))
        told = join_per_key(members, least, "v", "held", now["rows"], heavy_floor)
        pairs = F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("m").alias("v"), F.col("v").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))
        members = told.select(F.explode(pairs).alias("p")).select("p.v", "p.u").where("v <> u").distinct()
    else:
        raise RuntimeError("hash-to-min did not settle")
    group = members.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("g"))
    named = ids.select(F.col("id").alias("g"), F.col("name").alias("group"))
    # The members of one giant component share g: name the groups over their few distinct numbers, then join without moving the members.
    heads = join_group_names(group, named)
    return heads.join(ids.select(F.col("id").alias("v"), "name"), "v").select("name", "group")


def join_group_names(group: DataFrame, named: DataFrame) -> DataFrame:
    """(v, g) with the name of g; g's rows may be a third of all, so a heavy g is broadcast."""
    size = group.groupBy("g").agg(F.count(F.lit(1)).alias("held")).join(named, "g")
    total = group.count()
    return join_per_key(group, size, "g", "held", total)


def linked_groups(pairs: DataFrame, most_distance: float = 0.4, heavy_floor: int = 200_000) -> DataFrame:
    """Pairs (path_a, path_b, distance) → (path, group_path) for every file with a link.

    Two different locations are linked if a row names both with a distance that
    is neither null nor NaN and at most ``most_distance``. Spellings of one
    location are one file. Rows with a null path are ignored.
    """
    near = pairs.where(F.col("distance").isNotNull() & ~F.isnan("distance") & (F.col("distance") <= most_distance))
    edges = near.select(location(F.col("path_a")).alias("a"), location(F.col("path_b")).alias("b"))
    return hash_to_min(edges, heavy_floor).select(F.col("name").alias("path"), F.col("group").alias("group_path"))
