"""Long exact spans shared between records, by seeds, chaining and exact coverage.

Seeds are windows of ``k`` lines under a 128-bit digest. Every occurrence of a
window that stands in two or more files is matched with one occurrence in
another file (the smallest, or the largest where it is in the smallest's own
file), so a window that a third of all records hold gives one match per
occurrence and never all pairs. The matches of a record are chained per
partner: in order of position, a Fenwick tree over the partner's positions
gives the best predecessor under a linear gap cost. Every match ends up in one
chain, and a chain's matches on one diagonal are one exact piece, so the pieces of
all chains are exactly the lines that stand verbatim elsewhere; the gaps between
pieces are aligned for fuzzy passages.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.pairs import bucket_pairs
from codeloom.operators.skew import join_per_key
from codeloom.session import materialize

GAP_COST = 0.05


def chain_matches(pos: list[int], other: list[int]) -> list[list[int]]:
    """Collinear chains over matches (pos[i], other[i]), as lists of match numbers; every match is in one chain.

    The score of a match is 1 plus the best score of a match before it in both
    coordinates, less GAP_COST for each line skipped on either side.
    """
    n = len(pos)
    order = sorted(range(n), key=lambda i: (pos[i], other[i]))
    rank = {v: r + 1 for r, v in enumerate(sorted(set(other)))}
    size = len(rank)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and pos[order[j]] == pos[order[i]]:
            j += 1
        for m in order[i:j]:  # matches at one position can't follow each other
            best, r = (float("-inf"), -1), rank[other[m]] - 1
            while r > 0:
                best = max(best, tree[r])
                r -= r & -r
            gain = best[0] - GAP_COST * (pos[m] + other[m] - 2)
            score[m] = 1.0 + max(0.0, gain)
            back[m] = best[1] if gain > 0 else -1
        for m in order[i:j]:
            entry, r = (score[m] + GAP_COST * (pos[m] + other[m]), m), rank[other[m]]
            while r <= size:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = j
    used, chains = [False] * n, []
    for m in sorted(range(n), key=lambda i: (-score[i], pos[i], other[i])):
        chain = []
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = back[m]
        if chain:
            chains.append(chain[::-1])
    return chains


def usable_blocks(blocks: DataFrame) -> DataFrame:
    """block_id, path, start_line, lines of the usable blocks. Copies of a row stay: texts are read where they lie, and copies fall together in what is made of them."""
    cols = blocks.select("block_id", "path", "start_line", "source")
    return cols.where(" and ".join(f"{c} is not null" for c in cols.columns)).select("block_id", "path", "start_line", F.split("source", "\n").alias("lines"))


def seeds(texts: DataFrame, k: int) -> DataFrame:
    """key, block_id, path, pos (0-based) of every window of k lines."""
    starts = F.sequence(F.lit(0), F.size("lines") - k)
    return (
        texts.where(F.size("lines") >= k)
        .select("block_id", "path", "lines", F.explode(starts).alias("pos"))
        .select(F.unhex(F.md5(F.array_join(F.slice("lines", F.col("pos") + 1, k), "\n"))).alias("key"), "block_id", "path", "pos")
    )


def matches(texts: DataFrame, k: int, heavy_floor: int = 200_000) -> DataFrame:
    """One match in another file for every window that has one: block_id, pos, other_block, other_pos."""
    all_seeds = seeds(texts, k)
    place = F.struct("path", "block_id", "pos")
    shared = (
        all_seeds.groupBy("key")
        .agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count(F.lit(1)).alias("held"))
        .where(F.col("lo.path") != F.col("hi.path"))
    )
    total = texts.agg(F.sum(F.greatest(F.size("lines") - k + 1, F.lit(0)))).first()[0] or 0
    met = join_per_key(all_seeds, shared, "key", "held", total, heavy_floor)
    other = F.when(F.col("path") != F.col("lo.path"), F.col("lo")).otherwise(F.col("hi"))
    return met.withColumn("o", other).select("block_id", "pos", F.col("o.block_id").alias("other_block"), F.col("o.pos").alias("other_pos"))


CHAINS = "block_id bigint, chains array<struct<other:bigint,pieces:array<struct<first:int,last:int>>>>"


def exact_pieces(pos: list[int], other: list[int], k: int) -> list[tuple[int, int]]:
    """(first, last) of the lines under a chain's matches, one piece for each stretch on one diagonal."""
    pieces: list[list[int]] = []
    for i, (p, q) in enumerate(zip(pos, other)):
        if i and p - pos[i - 1] == q - other[i - 1] and p <= pieces[-1][1] + 1:
            pieces[-1][1] = p + k - 1
        else:
            pieces.append([p, p + k - 1])
    return [(a, b) for a, b in pieces]


def equal_lines(pos: list[int], other: list[int], k: int, x: list[str], y: list[str]) -> int:
    """The equal lines of the alignment along a chain: its exact pieces, and what an alignment of each gap between them adds. x, y: the lines from the first match to the last."""
    i = j = equal = 0
    for p, q in zip(pos, other):
        p, q = p - pos[0], q - other[0]
        skip = max(0, i - p, j - q)
        if skip >= k:
            continue
        p, q = p + skip, q + skip
        if p > i and q > j:
            equal += sum(m.size for m in difflib.SequenceMatcher(None, x[i:p], y[j:q], autojunk=False).get_matching_blocks())
        equal += k - skip
        i, j = p + k - skip, q + k - skip
    return equal


def _chains(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for pos, other, at in zip(pdf["pos"], pdf["other_block"], pdf["other_pos"]):
            by: dict[int, tuple[list[int], list[int]]] = {}
            for p, o, a in zip(pos.tolist(), other.tolist(), at.tolist()):
                mine = by.setdefault(o, ([], []))
                mine[0].append(p)
                mine[1].append(a)
            out.append([
                {"other": o, "pieces": [{"first": a, "last": b} for a, b in exact_pieces([ps[i] for i in chain], [qs[i] for i in chain], k)]}
                for o, (ps, qs) in sorted(by.items())
                for chain in chain_matches(ps, qs)
            ])
        yield pd.DataFrame({"block_id": pdf["block_id"], "chains": out})


def chained(texts: DataFrame, k: int, heavy_floor: int = 200_000) -> DataFrame:
    """The chains of every block that has a match. A block's matches are at most as many as its lines."""
    per_block = matches(texts, k, heavy_floor).groupBy("block_id").agg(
        F.collect_list("pos").alias("pos"), F.collect_list("other_block").alias("other_block"), F.collect_list("other_pos").alias("other_pos")
    )
    return per_block.mapInPandas(partial(_chains, k=k), CHAINS)


def shared_spans(blocks: DataFrame, k: int = 6, heavy_floor: int = 200_000) -> DataFrame:
    """Maximal runs of shared lines: block_id, first_line, last_line, lines (of the block).

    A line is shared if it lies in ``k`` or more consecutive lines that occur
    character by character in a block with another path. Lines end at ``\\n``;
    a carriage return is a character of its line. Blocks with a null id, path,
    start or source take no part, shorter blocks have no spans, exact copies of
    a row count once and an empty table gives no rows.
    """
    texts = usable_blocks(blocks)
    return _runs(chained(texts, k, heavy_floor), texts)


def _runs(chains: DataFrame, texts: DataFrame) -> DataFrame:
    """The exact pieces of all chains, as maximal runs."""
    pieces = F.array_sort(F.array_distinct(F.flatten(F.transform("chains", lambda c: c["pieces"]))))
    step = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("done"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

    def grow(acc, piece):
        p, end = piece["first"], F.greatest(piece["last"], acc["last"])
        closed = F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))
        fresh, joined = acc["first"].isNull(), p <= acc["last"] + 1
        return F.when(fresh, F.struct(acc["done"].alias("done"), p.alias("first"), end.alias("last"))).when(
            joined, F.struct(acc["done"].alias("done"), acc["first"].alias("first"), end.alias("last"))
        ).otherwise(F.struct(closed.alias("done"), p.alias("first"), piece["last"].alias("last")))

    def close(acc):
        return F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

    runs = chains.select("block_id", F.explode(F.aggregate(pieces, step, grow, close)).alias("r"))
    return runs.join(texts.select("block_id", "start_line", F.size("lines").alias("lines")).distinct(), "block_id").select(
        "block_id", (F.col("start_line") + F.col("r.first")).alias("first_line"), (F.col("start_line") + F.col("r.last")).alias("last_line"), "lines"
    )


def shared_share(blocks: DataFrame, k: int = 6) -> DataFrame:
    """How much of every block stands in blocks of other files: block_id, lines, shared_lines, share."""
    texts = usable_blocks(blocks)
    spans = _runs(chained(texts, k), texts).groupBy("block_id").agg(F.sum(F.col("last_line") - F.col("first_line") + 1).alias("shared_lines"))
    return texts.select("block_id", F.size("lines").cast("bigint").alias("lines")).distinct().join(spans, "block_id", "left").select(
        "block_id", "lines", F.coalesce("shared_lines", F.lit(0)).alias("shared_lines"), F.round(F.coalesce("shared_lines", F.lit(0)) / F.col("lines"), 6).alias("share")
    )


def pair_chains(reps: DataFrame, k: int) -> DataFrame:
    """a, b, pos, other_pos: the chains of every pair of different texts over all seeds they share, a < b, and of each text that stands in several files with itself.

    reps: block_id, lo, hi (first and last place, with path), lines; one row per distinct text. Hot seeds are paired in chunks.
    """
    occ = seeds(reps.withColumn("path", F.col("lo.path")), k).select(F.col("key").alias("bucket"), F.struct("block_id", "pos").alias("id"))
    occ = materialize(occ, "seeds")
    met = bucket_pairs(occ, occ.count()).select(F.col("a.block_id").alias("a"), F.col("b.block_id").alias("b"), F.col("a.pos").alias("p"), F.col("b.pos").alias("q"))
    within = met.where("a = b")
    diagonal = occ.select(F.col("id.block_id").alias("a"), F.col("id.block_id").alias("b"), F.col("id.pos").alias("p"), F.col("id.pos").alias("q"))
    every = met.union(within.select("a", "b", "q", "p")).union(diagonal)
    ends = lambda s: reps.select(F.col("block_id").alias(s), F.col("lo.path").alias(f"lo_{s}"), F.col("hi.path").alias(f"hi_{s}"))
    apart = every.groupBy("a", "b").agg(F.collect_list("p").alias("pos"), F.collect_list("q").alias("other_pos")).join(ends("a").hint("merge"), "a").join(ends("b").hint("merge"), "b").where("not (lo_a = hi_a and lo_b = hi_b and lo_a = lo_b)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for x, y, ps, qs in zip(pdf["a"], pdf["b"], pdf["pos"], pdf["other_pos"]):
                ps, qs = ps.tolist(), qs.tolist()
                rows += [(x, y, [ps[i] for i in chain], [qs[i] for i in chain]) for chain in chain_matches(ps, qs)]
            yield pd.DataFrame(rows, columns=["a", "b", "pos", "other_pos"])

    return apart.select("a", "b", "pos", "other_pos").mapInPandas(run, "a bigint, b bigint, pos array<int>, other_pos array<int>")


def fuzzy_passages(blocks: DataFrame, k: int = 6) -> DataFrame:
    """Every chain as a passage with its partner: both line ranges, the lines under exact seeds and the equal lines of the alignment.

    Every two different texts that share a seed are chained over all their
    seeds; a block has its passages with each such text once, in the text's
    first block in another file (or its last where the first is in the block's
    own file). Lines between two seeds of a chain are aligned line by line, so
    a passage with edited lines inside is one passage.
    """
    texts = usable_blocks(blocks).withColumn("text", F.unhex(F.md5(F.array_join("lines", "\n"))))
    place = F.struct("path", "block_id", "start_line")
    reps = materialize(texts.groupBy("text").agg(F.min("block_id").alias("block_id"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.first("lines").alias("lines")), "texts")
    members = texts.join(reps.select("text", F.col("block_id").alias("a")), "text").select("a", "block_id", "path", "start_line").distinct()
    one = pair_chains(reps, k)
    c = one.union(one.where("a <> b").select("b", "a", "other_pos", "pos"))
    mine = reps.select(F.col("block_id").alias("a"), "lines")
    theirs = reps.select(F.col("block_id").alias("b"), F.col("lines").alias("other_lines"))
    first, last = F.element_at("pos", 1), F.element_at("pos", -1) + k
    ofirst, olast = F.element_at("other_pos", 1), F.element_at("other_pos", -1) + k
    cut = c.join(mine.hint("merge"), "a").join(theirs.hint("merge"), "b").select(  # lists of lines are never broadcast by their packed size
        "a", "b", "pos", "other_pos", first.alias("first"), last.alias("last"), ofirst.alias("ofirst"), olast.alias("olast"),
        F.slice("lines", first + 1, last - first).alias("x"), F.slice("other_lines", ofirst + 1, olast - ofirst).alias("y"),
    )

    def align(batches):
        for pdf in batches:
            exact, equal = [], []
            for pos, other, a, b in zip(pdf["pos"], pdf["other_pos"], pdf["x"], pdf["y"]):
                pos = pos.tolist()
                exact.append(sum(min(k, q - p) for p, q in zip(pos, pos[1:])) + k)
                equal.append(equal_lines(pos, other.tolist(), k, list(a), list(b)))
            yield pdf.drop(columns=["pos", "other_pos", "x", "y"]).assign(exact_lines=exact, equal_lines=equal)

    aligned = cut.mapInPandas(align, "a bigint, b bigint, first int, last int, ofirst int, olast int, exact_lines int, equal_lines int")
    met = aligned.join(reps.select(F.col("block_id").alias("b"), "lo", "hi").hint("merge"), "b").join(members.hint("merge"), "a")
    other = F.when(F.col("path") != F.col("lo.path"), F.col("lo")).when(F.col("path") != F.col("hi.path"), F.col("hi"))
    return met.withColumn("o", other).where("o is not null").select(
        "block_id", (F.col("start_line") + F.col("first")).alias("first_line"), (F.col("start_line") + F.col("last") - 1).alias("last_line"), F.col("o.block_id").alias("other_block"),
        (F.col("o.start_line") + F.col("ofirst")).alias("other_first"), (F.col("o.start_line") + F.col("olast") - 1).alias("other_last"), "exact_lines", "equal_lines",
    )
