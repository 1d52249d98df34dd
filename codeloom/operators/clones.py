"""Clones of blocks and fragments by winnowed fingerprints, and what is derived from them."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.fingerprints import shared_window_prints, text_prints, window_buckets, window_prints
from codeloom.functions.text import file_name, jaccard, parent_dir, round2
from codeloom.operators.graph import components
from codeloom.operators.pairs import bucket_pairs, pairs_by_bucket
from codeloom.operators.skew import join_per_key
from codeloom.session import free_shuffles, materialize, materialize_alone

K, W = 8, 4
BLOCK_LINES, BLOCK_LIKE, FRAGMENT_LIKE, TOKENS_A_LINE, MIRROR_FILES = 5, 0.70, 0.85, 6, 3
WINDOWS = (30, 20, 15, 12, 10, 8, 7, 6, 5)
TOGETHER = 3  # window sizes matched at a time


def kgram_hashes(tokens: list[str], k: int = K) -> list[int]:
    """64-bit k-gram hashes in wrapping arithmetic: FNV-style over the bytes of a token, then base 31 over the tokens."""
    mask = 0xFFFFFFFFFFFFFFFF
    hashed = []
    for t in tokens:
        h = 0x811C9DC5
        for b in t.encode():
            h = (h ^ b) * 0x01000193 & mask
        hashed.append(h)
    out = []
    for i in range(len(hashed) - k + 1):
        g = 0
        for h in hashed[i : i + k]:
            g = (g * 31 + h) & mask
        out.append(g)
    return out


def winnow64(tokens: list[str], k: int = K, w: int = W) -> list[int]:
    """The fingerprints under the unsigned 64-bit hashes, sorted."""
    grams = kgram_hashes(tokens, k)
    wide = min(w, len(grams))
    return sorted({min(grams[i : i + wide]) for i in range(len(grams) - wide + 1)}) if grams else []


def similar_sets(sets: DataFrame, threshold: float, tag: str = "") -> tuple[DataFrame, DataFrame]:
    """(members, pairs) for rows (id, fps): members (id, class), pairs (a, b, similarity) of classes with Jaccard at or over the threshold.

    Rows with the same set form a class named after its smallest id. Two sets
    that reach the threshold share an element among the first
    n - ceil(threshold * n) + 1 of either in one common order, so only those are
    joined, and no pair is lost. Candidates are verified on the whole sets. With
    a column ``kind`` only rows of one kind are compared. ``tag`` ends the names of the tables written.
    """
    filled = sets.where(F.size("fps") > 0)
    filled = filled if "kind" in sets.columns else filled.withColumn("kind", F.lit(0))
    filled = filled.withColumn("fp", F.unhex(F.md5(F.concat_ws("|", F.col("kind").cast("string"), F.array_join(F.col("fps").cast("array<string>"), ",")))))
    heads = materialize(filled.groupBy("fp").agg(F.min("id").alias("class"), F.min_by("fps", "id").alias("fps"), F.min("kind").alias("kind")), f"fingerprints{tag}")
    members = materialize(filled.select("id", "fp").join(heads.select("fp", "class"), "fp").select("id", "class"), f"class-members{tag}")
    free_shuffles(heads.sparkSession)
    n = F.size("fps")
    prefix = heads.select(F.explode(F.slice("fps", F.lit(1), n - F.ceil(n * threshold - 1e-9).cast("int") + 1)).alias("f"), "kind", F.col("class").alias("id")).select(F.xxhash64("kind", "f").alias("bucket"), "id")
    total = heads.agg(F.sum(F.size("fps"))).first()[0] or 0
    a = heads.select(F.col("class").alias("a"), F.col("fps").alias("fa"), F.col("kind").alias("ka"))
    b = heads.select(F.col("class").alias("b"), F.col("fps").alias("fb"), F.col("kind").alias("kb"))
    close = (F.col("ka") == F.col("kb")) & (F.least(F.size("fa"), F.size("fb")) >= threshold * F.greatest(F.size("fa"), F.size("fb")) - 1e-9)
    pairs = bucket_pairs(prefix, total).join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(close).select("a", "b", jaccard(F.col("fa"), F.col("fb")).alias("similarity")).where(F.col("similarity") >= threshold)
    pairs = materialize(pairs, f"similar-sets{tag}")
    free_shuffles(heads.sparkSession)
    return members, pairs


def block_fingerprints(blocks: DataFrame) -> DataFrame:
    """id, fps of the blocks of BLOCK_LINES lines or more."""
    kept = blocks.where((F.col("end_line") - F.col("start_line") + 1 >= BLOCK_LINES) & F.col("source").isNotNull()).select(F.col("block_id").alias("id"), "source")
    return kept.mapInArrow(text_prints(K, W), f"id {kept.schema['id'].dataType.simpleString()}, fps array<bigint>").distinct()


def block_clones(blocks: DataFrame, threshold: float = BLOCK_LIKE) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) over blocks; see similar_sets."""
    return similar_sets(block_fingerprints(blocks), threshold)


def copy_links(members: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b, similarity 1.0): every member of a class with the first member in another file, or the last where the first is in its own. places: id, file."""
    placed = members.join(places.select("id", "file"), "id")
    spot = F.struct("file", "id")
    ends = placed.groupBy("class").agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"), F.count(F.lit(1)).alias("held")).where("lo.file <> hi.file")
    total = members.count()
    met = join_per_key(placed, ends, "class", "held", total)
    other = F.when(F.col("file") != F.col("lo.file"), F.col("lo.id")).otherwise(F.col("hi.id"))
    return met.select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b"), F.lit(1.0).alias("similarity")).distinct()


def pair_links(members: DataFrame, pairs: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b, similarity): every member of either class of a pair with the first member of the other class, or the last where the first is in its own file.

    Rows per pair are the members of both classes; a member without a partner in another file has none. places: id, file.
    """
    placed = members.join(places.select("id", "file").where("file is not null"), "id")
    spot = F.struct("file", "id")
    ends = placed.groupBy(F.col("class").alias("near")).agg(F.min(spot).alias("lo"), F.max(spot).alias("hi"))
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("near"), "similarity").union(pairs.select("b", "a", "similarity"))
    met = both.join(ends, "near").join(placed, "class")
    other = F.when(F.col("file") != F.col("lo.file"), F.col("lo.id")).when(F.col("file") != F.col("hi.file"), F.col("hi.id"))
    return met.withColumn("other", other).where("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "similarity").distinct()


def located_issues(members: DataFrame, pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Clone issues with both locations. places: id, file, name, start_line, end_line.

    Every member of a class gives one issue with a copy in another file, and
    one with each similar class that has a member in another file. Issues
    inside one file are left out.
    """
    links = pair_links(members, pairs, places).union(copy_links(members, places))
    side = lambda s: places.select(F.col("id").alias(s), *[F.col(c).alias(f"{n}_{s}") for c, n in (("file", "file"), ("name", "name"), ("start_line", "start"), ("end_line", "end"))])
    full = links.join(side("a"), "a").join(side("b"), "b").where("file_a <> file_b")
    return full.select(round2(F.col("similarity")).alias("confidence"), "file_a", "name_a", "start_a", "end_a", "file_b", "name_b", "start_b", "end_b")


def fragments(files: DataFrame, sizes=WINDOWS) -> DataFrame:
    """path, start_line, end_line, fps of sliding windows of lines: step 4 for more than ten lines, else 2; windows with fewer than two words a line are dropped."""
    texts = files.where("path is not null and source is not null").select("path", "source")
    return texts.mapInArrow(window_prints(tuple(sizes), K, W), "path string, start_line bigint, end_line bigint, fps array<bigint>").distinct()


def shared_fragments(files: DataFrame, sizes=WINDOWS, threshold: float = FRAGMENT_LIKE) -> DataFrame:
    """The fragments that can match one of another file at the threshold.

    Two windows that reach it share a fingerprint of their prefixes, so a window
    whose prefix fingerprints occur in no other file has no match. The windows
    are made twice: first only the fingerprints of each file are shuffled, then
    files meet those they share, and other windows are never written. All texts
    of a path are read together, so its windows are made distinct in place.
    """
    texts = files.where("path is not null and source is not null").select(F.xxhash64("path").alias("key"), "path", "source")
    buckets = texts.select("key", "source").mapInArrow(window_buckets(tuple(sizes), K, W, threshold), "key bigint, bucket bigint")
    met = buckets.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1").groupBy("key").agg(F.collect_set("bucket").alias("buckets"))
    whole = texts.repartition("key").groupBy("key", "path").agg(F.collect_set("source").alias("sources"))
    kept = whole.join(met.hint("merge"), "key").select("path", "sources", "buckets")
    return kept.mapInArrow(shared_window_prints(tuple(sizes), K, W, threshold), "path string, start_line bigint, end_line bigint, fps array<bigint>")


def fragment_matches(files: DataFrame, sizes=WINDOWS, threshold: float = FRAGMENT_LIKE) -> DataFrame:
    """path_a, start_a, end_a, path_b, start_b, end_b, confidence of alike windows of the same size in different files, path_a < path_b.

    Windows with equal fingerprints are matched with their class's first window
    in another file, not with each other; similar windows with the first of
    the other's class in another file. Sizes never meet, so a few are taken at
    a time, and what was written for them is deleted before the next.
    """
    spark = files.sparkSession
    free_shuffles(spark)
    frags = materialize(shared_fragments(files, sizes, threshold).withColumn("id", F.struct(F.unhex(F.md5("path")).alias("f"), F.col("start_line").cast("int").alias("s"), F.col("end_line").cast("int").alias("e"))), "fragments")
    free_shuffles(spark)
    kind = (F.col("end_line") - F.col("start_line") + 1).cast("int")
    some = [tuple(sizes)[i : i + TOGETHER] for i in range(0, len(sizes), TOGETHER)]
    return reduce(DataFrame.unionByName, [materialize_alone(lambda s=s: _matches_of(frags.where(kind.isin(*s)), kind, threshold, f"-{s[0]}"), spark, "fragment-matches") for s in some])


def _matches_of(frags: DataFrame, kind: Column, threshold: float, tag: str) -> DataFrame:
    """The matches of fragment_matches among the given windows."""
    members, pairs = similar_sets(frags.select("id", "fps", kind.alias("kind")), threshold, tag)
    where = frags.select("id", "path", "start_line", "end_line")
    places = where.withColumnRenamed("path", "file")
    links = pair_links(members, pairs, places).union(copy_links(members, places))
    a = where.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_1") for c in ("path", "start_line", "end_line")])
    b = where.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_2") for c in ("path", "start_line", "end_line")])
    full = links.join(a, "a").join(b, "b").where("path_1 <> path_2")
    first = F.col("path_1") < F.col("path_2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return full.select(
        pick("path_1", "path_2").alias("path_a"), pick("start_line_1", "start_line_2").alias("start_a"), pick("end_line_1", "end_line_2").alias("end_a"),
        pick("path_2", "path_1").alias("path_b"), pick("start_line_2", "start_line_1").alias("start_b"), pick("end_line_2", "end_line_1").alias("end_b"), F.col("similarity").alias("confidence"),
    )


MERGED = "path_a string, start_a bigint, end_a bigint, path_b string, start_b bigint, end_b bigint, confidence double"


def merge_matches(rows: list[tuple]) -> list[list]:
    """Matches (start_a, end_a, start_b, end_b, confidence) of one pair of files, merged first-fit in order where either side overlaps or touches."""
    merged: list[list] = []
    for sa, ea, sb, eb, c in sorted(rows):
        for m in merged:
            if (sa <= m[1] + 1 and ea >= m[0]) or (sb <= m[3] + 1 and eb >= m[2]):
                m[:] = [min(m[0], sa), max(m[1], ea), min(m[2], sb), max(m[3], eb), max(m[4], c)]
                break
        else:
            merged.append([sa, ea, sb, eb, c])
    return merged


def merged_fragments(matches: DataFrame) -> DataFrame:
    """Overlapping matches of a pair of files as one; a group holds the windows of two files only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = merge_matches(list(zip(pdf["start_a"], pdf["end_a"], pdf["start_b"], pdf["end_b"], pdf["confidence"])))
        pa, pb = pdf["path_a"].iat[0], pdf["path_b"].iat[0]
        return pd.DataFrame([[pa, m[0], m[1], pb, m[2], m[3], round(m[4] * 100) / 100] for m in rows], columns=["path_a", "start_a", "end_a", "path_b", "start_b", "end_b", "confidence"])

    return matches.groupBy("path_a", "path_b").applyInPandas(run, MERGED)


def not_covered(frags: DataFrame, issues: DataFrame) -> DataFrame:
    """Fragments of which not both sides lie inside a block location of the issues. Both are read more than once, so they are written first."""
    frags = materialize(frags, "merged-fragments")
    ranges = issues.select(F.col("file_a").alias("file"), F.col("start_a").alias("s"), F.col("end_a").alias("e")).union(issues.select("file_b", "start_b", "end_b")).distinct()
    ranges = materialize(ranges, "block-places")
    ids = ["path_a", "start_a", "end_a", "path_b", "start_b", "end_b"]
    inside = lambda d, x: d.join(ranges, (F.col(f"path_{x}") == F.col("file")) & (F.col("s") <= F.col(f"start_{x}")) & (F.col("e") >= F.col(f"end_{x}")), "left_semi")
    both = inside(inside(frags, "a"), "b").select(*ids)
    return frags.join(both, ids, "left_anti")


def clone_groups(issues: DataFrame) -> DataFrame:
    """group_id, file, start_line, end_line: instances of groups of issues that share a location exactly.

    Issues at one location belong together if their smaller spans differ by a
    factor of ten at most; over the sorted spans of a location it is enough to
    compare neighbours. Issues with the same span at a location meet at the
    first of them, so a location with very many issues gives one link each.
    """
    key = F.concat_ws("|", "file_a", F.lpad(F.col("start_a").cast("string"), 9, "0"), F.lpad(F.col("end_a").cast("string"), 9, "0"), "file_b", F.lpad(F.col("start_b").cast("string"), 9, "0"), F.lpad(F.col("end_b").cast("string"), 9, "0"))
    span = F.least(F.col("end_a") - F.col("start_a"), F.col("end_b") - F.col("start_b")) + 1
    rows = materialize(issues.select(key.alias("issue"), span.alias("span"), *[c for c in issues.columns if c[-2:] in ("_a", "_b")]).dropDuplicates(["issue"]), "clone-issues")
    at = rows.select("issue", "span", F.col("file_a").alias("file"), F.col("start_a").alias("start_line"), F.col("end_a").alias("end_line")).union(rows.select("issue", "span", "file_b", "start_b", "end_b"))
    place = ["file", "start_line", "end_line"]
    first = at.groupBy(*place, "span").agg(F.min("issue").alias("first"))
    # the neighbours of each span at a location: distinct spans only, so a small list
    spans = first.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("span", "first"))).alias("s"))
    steps = spans.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: F.struct(F.element_at("s", i).alias("x"), F.when(i < F.size("s"), F.element_at("s", F.least(i + 1, F.size("s")))).alias("y")))).alias("p"))
    chain = steps.where("p.y is not null").where(F.floor(F.col("p.y.span") / F.greatest(F.col("p.x.span"), F.lit(1))) <= 10).select(F.col("p.x.first").alias("a"), F.col("p.y.first").alias("b"))
    same = at.join(first, [*place, "span"]).where("issue <> first").select(F.col("issue").alias("a"), F.col("first").alias("b"))
    comp = components(chain.union(same).distinct())
    grouped = at.join(comp.withColumnRenamed("name", "issue"), "issue", "left").select(F.coalesce("group", "issue").alias("g"), *place).distinct()
    return grouped.select(F.xxhash64("g").alias("group_id"), *place)


def group_sizes(instances: DataFrame) -> DataFrame:
    """group_id, instances, line_count (least span), token_count."""
    return instances.groupBy("group_id").agg(F.count(F.lit(1)).alias("instances"), F.min(F.col("end_line") - F.col("start_line") + 1).alias("line_count")).where("instances >= 2").withColumn("token_count", F.col("line_count") * TOKENS_A_LINE)


def _pairs_in_groups(instances: DataFrame, item: Column, only: DataFrame | None = None) -> DataFrame:
    """group_id, x, y, line_count for the distinct items of each group, x < y; ``only`` (file) restricts the instances that are paired."""
    sizes = group_sizes(instances).select("group_id", "line_count")
    kept = instances if only is None else instances.join(only, "file", "left_semi")
    names = materialize(kept.select(F.col("group_id").alias("bucket"), item.alias("id")).distinct(), "group-members")
    return pairs_by_bucket(names, names.count()).select(F.col("bucket").alias("group_id"), F.col("a").alias("x"), F.col("b").alias("y")).join(sizes, "group_id")


def clone_families(instances: DataFrame) -> DataFrame:
    """file_a, file_b, group_count, lines of pairs of files that share two or more groups."""
    # a file in one group only can't share two
    often = instances.groupBy("file").agg(F.countDistinct("group_id").alias("n")).where("n >= 2").select("file")
    p = _pairs_in_groups(instances, F.col("file"), often)
    return p.groupBy(F.col("x").alias("file_a"), F.col("y").alias("file_b")).agg(F.count(F.lit(1)).alias("group_count"), F.sum("line_count").alias("lines")).where("group_count >= 2")


def mirrored_directories(instances: DataFrame) -> DataFrame:
    """dir_a, dir_b, files (array of names), lines of pairs of directories whose shared groups name three or more files."""
    p = _pairs_in_groups(instances, parent_dir(F.col("file")))
    here = instances.select("group_id", parent_dir(F.col("file")).alias("dir"), file_name(F.col("file")).alias("name")).distinct().groupBy("group_id", "dir").agg(F.collect_set("name").alias("names"))
    a = here.select("group_id", F.col("dir").alias("x"), F.col("names").alias("na"))
    b = here.select("group_id", F.col("dir").alias("y"), F.col("names").alias("nb"))
    both = p.join(a, ["group_id", "x"]).join(b, ["group_id", "y"])
    out = both.groupBy(F.col("x").alias("dir_a"), F.col("y").alias("dir_b")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.array_union("na", "nb"))))).alias("files"), F.sum("line_count").alias("lines"))
    return out.where(F.size("files") >= MIRROR_FILES)


def duplication_stats(instances: DataFrame, total_lines: DataFrame) -> DataFrame:
    """total_lines, duplicated_lines, duplication_percentage, clone_groups, clone_instances. total_lines: one row, column total_lines."""
    sizes = group_sizes(instances)
    kept = instances.join(sizes.select("group_id"), "group_id", "left_semi")
    unique = kept.select("file", F.explode(F.sequence("start_line", "end_line")).alias("line")).distinct().agg(F.count(F.lit(1)).alias("unique_lines"))
    est = sizes.agg(F.coalesce(F.sum(F.col("line_count") * F.col("instances")), F.lit(0)).alias("estimated"), F.count(F.lit(1)).alias("clone_groups"), F.coalesce(F.sum("instances"), F.lit(0)).alias("clone_instances"))
    one = total_lines.crossJoin(F.broadcast(unique)).crossJoin(F.broadcast(est))  # one row each
    dup = F.least("unique_lines", "estimated")
    return one.select("total_lines", dup.alias("duplicated_lines"), F.when(F.col("total_lines") > 0, dup / F.col("total_lines") * 100).otherwise(0.0).alias("duplication_percentage"), "clone_groups", "clone_instances")
