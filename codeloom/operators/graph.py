"""Reachability, cycles, components and neighbourhoods of the import graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.operators.skew import join_per_key
from codeloom.session import counted_write, drop_path, shared_dir

UNREACHABLE = "not reachable from any entry point"
FRAMEWORK_DEAD = "implicit entry point not reachable from runtime"


HOPS = 4  # edges followed in one job
LOCAL_EDGES = 500_000  # edges that one task unites
LABEL = "name string, group string"


def reachable(edges: DataFrame, seeds: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Nodes reachable from ``seeds`` (node) over ``edges`` (source, target), seeds included.

    A frontier loop: each round follows HOPS edges from the newest nodes and
    keeps the nodes not seen before. Frontiers are written to the shared folder,
    so a lost executor costs one round. Nulls are ignored; empty inputs give
    what the seeds give. Raises if nodes are still found after ``most_rounds`` rounds.
    """
    spark = edges.sparkSession
    root = shared_dir(spark, "reach")
    e = edges.where("source is not null and target is not null").select("source", "target").distinct()
    e.write.parquet(f"{root}/edges")
    e = spark.read.schema("source string, target string").parquet(f"{root}/edges")
    n = counted_write(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node is not null").distinct(), f"{root}/reached/r=0")
    rounds = 0
    while n:
        rounds += 1
        if rounds > most_rounds:
            raise RuntimeError("reachability did not settle")
        reached = spark.read.schema("node string, r int").parquet(f"{root}/reached")
        step, found = reached.where(F.col("r") == rounds - 1).select("node"), None
        for _ in range(HOPS):
            step = e.join(step, e["source"] == step["node"], "left_semi").select(F.col("target").alias("node")).distinct()
            found = step if found is None else found.union(step)
        n = counted_write(found.distinct().join(reached.select("node"), "node", "left_anti"), f"{root}/reached/r={rounds}")
    return spark.read.schema("node string, r int").parquet(f"{root}/reached").select("node")


def dead_code(nodes: DataFrame, edges: DataFrame, entries: DataFrame, loc: DataFrame) -> DataFrame:
    """path, lines_of_code, confidence, reason of the nodes that no entry reaches; entries that are no nodes seed nothing."""
    keys = nodes.select("path").where("path is not null").distinct()
    seeds = entries.select("path").join(keys, "path", "left_semi")
    dead = keys.join(reachable(edges, seeds).withColumnRenamed("node", "path"), "path", "left_anti")
    return _with_loc(dead, loc, 0.95, UNREACHABLE)


def framework_dead(nodes: DataFrame, edges: DataFrame, framework: DataFrame, implicit: DataFrame, loc: DataFrame, folders: str = "^(src|__mocks__|scripts)/") -> DataFrame:
    """Implicit entries below the folders (src, __mocks__ and scripts at the root) that no framework entry reaches; tests are left out."""
    keys = nodes.select("path").where("path is not null").distinct()
    live = reachable(edges, framework.select("path")).withColumnRenamed("node", "path")
    dead = (
        implicit.select("path").distinct().join(live, "path", "left_anti").join(keys, "path", "left_semi")
        .where(F.col("path").rlike(folders) & ~F.col("path").rlike(r"\.(test|spec)\."))
    )
    return _with_loc(dead, loc, 0.7, FRAMEWORK_DEAD)


def _with_loc(dead: DataFrame, loc: DataFrame, confidence: float, reason: str) -> DataFrame:
    sizes = loc.groupBy("path").agg(F.max("loc").alias("loc"))
    return dead.join(sizes, "path", "left").select("path", F.coalesce("loc", F.lit(0)).cast("bigint").alias("lines_of_code"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))


def trim_acyclic(edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """The edges between nodes that can reach a cycle: targets without edges of their own are dropped, round by round.

    Sinks lie on no cycle and don't change where a search enters one. Raises if
    edges are still dropped after ``most_rounds`` rounds.
    """
    spark = edges.sparkSession
    root = shared_dir(spark, "trim")
    now = edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct()
    before = None
    for r in range(most_rounds):
        n = counted_write(now, f"{root}/e{r}")
        now = spark.read.schema("source string, target string").parquet(f"{root}/e{r}")
        if r:
            drop_path(spark, f"{root}/e{r - 1}")
        if n == before or not n:
            return now
        before = n
        for _ in range(HOPS):
            now = now.join(now.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
    raise RuntimeError("trimming did not settle")


def cycles_of(targets: dict[str, list[str]]) -> list[list[str]]:
    """One cycle for each back edge of a depth-first search over sorted nodes and targets, each rotated to its smallest node, all distinct and sorted."""
    colour: dict[str, int] = {}
    found: set[tuple[str, ...]] = set()
    for start in sorted(targets):
        if colour.get(start):
            continue
        colour[start] = 1
        path, place, work = [start], {start: 0}, [iter(targets.get(start, ()))]
        while work:
            for nxt in work[-1]:
                if nxt == path[-1]:
                    continue
                c = colour.get(nxt, 0)
                if c == 1:
                    ring = path[place[nxt] :]
                    least = ring.index(min(ring))
                    found.add(tuple(ring[least:] + ring[:least]))
                elif c == 0:
                    colour[nxt] = 1
                    place[nxt] = len(path)
                    path.append(nxt)
                    work.append(iter(targets.get(nxt, ())))
                    break
            else:
                work.pop()
                colour[path[-1]] = 2
                del place[path[-1]]
                path.pop()
    return [list(x) for x in sorted(found)]


def circular_dependencies(edges: DataFrame) -> DataFrame:
    """files (array): the cycles of the import graph.

    Sinks are trimmed in Spark first; then every weakly connected component
    that is left is searched on its own. A component's search meets its nodes
    in the same order as a search over the whole graph would, so the cycles are
    the same, and components run side by side.
    """
    core = trim_acyclic(edges)
    groups = components(core.select(F.col("source").alias("a"), F.col("target").alias("b")))
    tagged = core.join(groups.select(F.col("name").alias("source"), F.col("group")), "source")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        targets: dict[str, list[str]] = {}
        for s, t in sorted(zip(pdf["source"], pdf["target"])):
            targets.setdefault(s, []).append(t)
        return pd.DataFrame({"files": cycles_of(targets)})

    return tagged.groupBy("group").applyInPandas(search, "files array<string>")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (a, b) of edges → (name, group): the least name that its edges lead to."""
    above: dict[str, str] = {}

    def least(x: str) -> str:
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = least(x), least(y)
            if x != y:
                above[max(x, y)] = min(x, y)
    names = list(above)
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([least(x) for x in part], pa.string())], ["name", "group"])


def components(edges: DataFrame, most_rounds: int = 200, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(name, group) for edges (a, b): the smallest name of the weakly connected component.

    While more than ``local_edges`` edges are left, every node is merged into
    the first of its neighbours and itself in the order of their hashes, which
    about halves a chain of nodes whatever its names; the rest, whose size has
    that bound, is united in one task. Then the merges are followed back.
    """
    spark = edges.sparkSession
    root = shared_dir(spark, "components")
    ends = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    now, merges = edges.where("a is not null and b is not null and a <> b").select(*ends("a", "b")).distinct(), []
    n = counted_write(now, f"{root}/e0")
    now = spark.read.schema("a string, b string").parquet(f"{root}/e0")
    while n > local_edges:
        r = len(merges)
        if r == most_rounds:
            raise RuntimeError("components did not settle")
        place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        near = now.union(now.select("b", "a")).groupBy("a").agg(F.min(place("b")).alias("first"), F.count(F.lit(1)).alias("held"))
        size = counted_write(near.select(F.col("a").alias("name"), F.least(place("a"), "first")["v"].alias("into"), "held"), f"{root}/m{r}")
        merged = spark.read.schema("name string, into string, held bigint").parquet(f"{root}/m{r}")
        half = join_per_key(now.withColumnRenamed("a", "name"), merged, "name", "held", 2 * n).select(F.col("into").alias("x"), F.col("b").alias("name"))
        now = join_per_key(half, merged, "name", "held", 2 * n).where("x <> into").select(*ends("x", "into")).distinct()
        n = counted_write(now, f"{root}/e{r + 1}")
        now = spark.read.schema("a string, b string").parquet(f"{root}/e{r + 1}")
        drop_path(spark, f"{root}/e{r}")
        merges.append((merged, size))
    label = _kept(now.coalesce(1).mapInArrow(_united, LABEL), f"{root}/l{len(merges)}")
    for r in reversed(range(len(merges))):
        merged, size = merges[r]
        held = merged.groupBy("into").agg(F.count(F.lit(1)).alias("held"))
        onward = held.join(label.withColumnRenamed("name", "into"), "into", "left").select("into", F.coalesce("group", "into").alias("group"), "held")
        label = _kept(join_per_key(merged.select("name", "into"), onward, "into", "held", size).select("name", "group"), f"{root}/l{r}")
    if not merges:
        return label
    least = label.groupBy("group").agg(F.min("name").alias("least"), F.count(F.lit(1)).alias("held"))
    return join_per_key(label, least, "group", "held", merges[0][1]).select("name", F.col("least").alias("group"))


def _kept(label: DataFrame, path: str) -> DataFrame:
    label.write.parquet(path)
    return label.sparkSession.read.schema(LABEL).parquet(path)


def neighbourhood(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """path: the chosen nodes and the nodes one edge away in either direction."""
    c = chosen.select("path").distinct()
    out = edges.join(c, edges["source"] == c["path"], "left_semi").select(F.col("target").alias("path"))
    into = edges.join(c, edges["target"] == c["path"], "left_semi").select(F.col("source").alias("path"))
    return c.union(out).union(into).where("path is not null").distinct()


def used_through_reexports(unused: DataFrame, imported: DataFrame, reexports: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Of ``unused`` (path, name), those imported through a chain of barrels that re-export them.

    imported: target, name; reexports: barrel, target, name (``*`` is all).
    The frontier carries (origin, file, name) and stops where nothing new comes;
    raises if something still comes after ``most_rounds`` rounds.
    """
    spark = unused.sparkSession
    root = shared_dir(spark, "chains")
    links = reexports.select("barrel", F.col("target").alias("file"), F.col("name").alias("via")).distinct()
    n, r = counted_write(unused.select("path", "name", F.col("path").alias("file")).distinct(), f"{root}/seen/r=0"), 0
    while n:
        r += 1
        if r > most_rounds:
            raise RuntimeError("re-export chains did not settle")
        seen = spark.read.schema("path string, name string, file string, r int").parquet(f"{root}/seen")
        newest = seen.where(F.col("r") == r - 1).drop("r")
        step = newest.join(links, "file").where((F.col("via") == "*") | (F.col("via") == F.col("name"))).select("path", "name", F.col("barrel").alias("file")).distinct()
        n = counted_write(step.join(seen.drop("r"), ["path", "name", "file"], "left_anti"), f"{root}/seen/r={r}")
    seen = spark.read.schema("path string, name string, file string, r int").parquet(f"{root}/seen")
    hit = imported.select(F.col("target").alias("file"), "name").distinct()
    return seen.join(hit, ["file", "name"], "left_semi").select("path", "name").distinct()
