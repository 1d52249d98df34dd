"""Near-duplicate records with small edits, by MinHash banding and verification on the full sets.

Records with the same shingle set form a class, and only classes are compared.
With 5 rows a band and 35 bands a pair at the threshold 0.7 shares a band with
probability 1 - (1 - 0.7^5)^35 = 0.998, one at 0.75 with 0.9999. Pairs of sets
whose sizes alone rule the threshold out are dropped inside their bucket; the
others are verified on their whole sets. Buckets that many classes share are cut
into chunks and compared chunk by chunk, so no task holds an unbounded bucket and
no pair is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.groups import hash_to_min
from codeloom.operators.pairs import CHUNK, bucket_pairs
from codeloom.operators.skew import join_per_key
from codeloom.session import materialize

TOKEN = re.compile(r"[A-Za-z0-9_$]+|[^\sA-Za-z0-9_$]")
ROWS, BANDS, SEED = 5, 35, 7


class TokenHashes(dict):
    """token → hash, filled when asked."""

    def __missing__(self, token: str) -> int:
        h = self[token] = xxhash.xxh3_64_intdigest(token)
        return h


def shingle_set(text: str, width: int = 3, known: TokenHashes | None = None) -> np.ndarray:
    """The distinct runs of ``width`` tokens as sorted 64-bit hashes; empty for texts with fewer tokens."""
    tokens = TOKEN.findall(text)
    if len(tokens) < width:
        return np.empty(0, np.uint64)
    known = TokenHashes() if known is None else known
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out += h[i : len(h) - width + 1 + i]
    return np.unique(_mix(out))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(sets: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band of the set's MinHash signature. The elements are hashes already, so a multiplication and an addition make a new order of their upper halves."""
    factors, terms = _orders(rows * bands)
    upper = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(rows * bands, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(upper), 256):
        part = upper[at : at + 256, None] * factors
        part += terms
        np.minimum(low, part.min(axis=0), out=low)
    low = low.astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        keys = _mix(keys ^ low[r::rows]) + np.uint64(r)
    return keys


@cache
def _orders(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


SETS = "id bigint, path string, fp binary, key bigint, n int, shingles array<bigint>, bands array<bigint>"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, paths, fps, keys, sizes, sets, bands = [], [], [], [], [], [], []
        known = TokenHashes()
        for i, path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            s = shingle_set(text, known=known)
            if len(s):
                fp = xxhash.xxh3_128_digest(s.tobytes())
                ids.append(i)
                paths.append(path)
                fps.append(fp)
                keys.append(int.from_bytes(fp[:8], "little", signed=True))
                sizes.append(len(s))
                sets.append(s.view(np.int64))
                bands.append(band_keys(s).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(fps, pa.binary()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sets, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
            ["id", "path", "fp", "key", "n", "shingles", "bands"],
        )


def similar_classes(blocks: DataFrame, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (id, path, class), once each, and pairs (a, b, similarity) of classes at or over the threshold, a <> b, each once.

    The class is the smallest id with the same shingle set. Texts are read
    where they lie; only numbers are shuffled. Buckets hold half of a set's
    128-bit digest and its size: where two sets share that half, both are
    joined and verified.
    """
    texts = blocks.select(F.col("block_id").alias("id"), "path", "source").where("id is not null and path is not null and source is not null")
    sets = materialize(texts.mapInArrow(_signatures, SETS), "signatures")
    small = sets.select("id", "path", "fp").distinct()
    classes = materialize(small.groupBy("fp").agg(F.min("id").alias("class")), "classes")
    members = materialize(small.join(classes, "fp").select("id", "path", "class"), "members")
    low = lambda x, y: F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"])
    once = sets.groupBy("key", "n").agg(F.any_value("bands").alias("bands"))
    buckets = once.select(F.explode("bands").alias("bucket"), F.struct("n", "key").alias("id"))
    candidates = bucket_pairs(buckets, classes.count() * BANDS, keep=low).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    candidates = materialize(candidates, "candidates")
    needed = candidates.select(F.col("a").alias("key")).union(candidates.select("b")).distinct()
    whole = sets.join(needed, "key", "left_semi").groupBy("key", "fp").agg(F.any_value("shingles").alias("s")).join(classes, "fp")
    whole = materialize(whole.select("key", "class", "s"), "sets")
    size = F.size("sa") + F.size("sb")
    shared = F.size(F.array_intersect("sa", "sb"))
    found = (
        candidates.join(whole.select(F.col("key").alias("a"), F.col("class").alias("ca"), F.col("s").alias("sa")).hint("merge"), "a")
        .join(whole.select(F.col("key").alias("b"), F.col("class").alias("cb"), F.col("s").alias("sb")).hint("merge"), "b")
        .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), (shared / (size - shared)).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )
    return members, materialize(found.distinct(), "similar")


def near_duplicate_pairs(blocks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """All pairs (block_a, block_b), block_a < block_b, of blocks with different paths at or over the threshold.

    Blocks with null id, path or source and blocks with fewer than three
    tokens have no pairs; exact copies of a row count once; an empty table
    gives no rows. The pairs themselves are the result asked for. Members of
    large classes are cut into chunks, and a pair of chunks is joined on its own.
    """
    members, pairs = similar_classes(blocks, threshold)
    sizes = members.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"), F.min("path").alias("lo"), F.max("path").alias("hi"))
    same = sizes.where("lo <> hi").select(F.col("class").alias("a"), F.col("class").alias("b"))
    parts = lambda c, n: sizes.select(F.col("class").alias(c), F.col("parts").alias(n))
    linked = pairs.select("a", "b").union(same).join(parts("a", "m"), "a").join(parts("b", "n"), "b")
    linked = linked.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = members.join(sizes.select("class", "parts"), "class").withColumn("part", F.pmod(F.xxhash64("id", "path"), F.col("parts")).cast("int"))
    x = cut.select(F.col("class").alias("a"), F.col("part").alias("i"), F.col("id").alias("x"), F.col("path").alias("px"))
    y = cut.select(F.col("class").alias("b"), F.col("part").alias("j"), F.col("id").alias("y"), F.col("path").alias("py"))
    full = linked.join(x, ["a", "i"]).join(y, ["b", "j"]).where((F.col("px") != F.col("py")) & (F.col("x") != F.col("y")) & ((F.col("a") != F.col("b")) | (F.col("x") < F.col("y"))))
    return full.select(F.least("x", "y").alias("block_a"), F.greatest("x", "y").alias("block_b")).distinct()


def near_duplicate_groups(blocks: DataFrame, threshold: float = 0.7) -> DataFrame:
    """block_id, class_id, links, group_id: one row for every block with a shingle set.

    ``class_id`` is the smallest block with the same set, ``links`` the number
    of similar classes with a block in another file, ``group_id`` the smallest
    class reachable over such links; copies share a group.
    """
    members, pairs = similar_classes(blocks, threshold)
    ends = members.groupBy("class").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    end = lambda c: ends.select(F.col("class").alias(c), F.col("lo").alias(f"lo_{c}"), F.col("hi").alias(f"hi_{c}"))
    apart = materialize(pairs.join(end("a"), "a").join(end("b"), "b").where("not (lo_a = hi_a and lo_b = hi_b and lo_a = lo_b)").select("a", "b"), "links")
    shift = F.lit(str(2**63)).cast("decimal(20,0)")  # names in the order of the numbers, negative ones too
    name = lambda c: F.lpad((F.col(c).cast("decimal(20,0)") + shift).cast("string"), 20, "0")
    number = lambda c: (F.col(c).cast("decimal(20,0)") - shift).cast("bigint")
    groups = hash_to_min(apart.select(name("a").alias("a"), name("b").alias("b"))).select(number("name").alias("class"), number("group").alias("grp"))
    links = apart.select(F.col("a").alias("class")).union(apart.select("b")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    by_class = ends.select("class").join(groups, "class", "left").join(links, "class", "left")
    per_class = by_class.select("class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("grp", "class").alias("group_id"))
    held = members.groupBy("class").agg(F.count(F.lit(1)).alias("held")).join(per_class, "class")
    told = join_per_key(members.select("id", "class"), held, "class", "held", members.count())
    return told.select(F.col("id").alias("block_id"), F.col("class").alias("class_id"), "links", "group_id").distinct()
