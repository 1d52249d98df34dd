"""Mixing sources to target weights, by balanced sampling with the cube method.

The mix is as large as the targets and the caps allow. Every document of a
source is used equally often in expectation: a whole number of times, plus one
more with a fractional probability. Which documents get the extra use is
chosen so that both the tokens and the number of documents of a source come out
as expected: the flight phase moves three fractional probabilities at a time
along the null space of the two constraints until one of them is 0 or 1. It
runs in chunks of bounded size; each leaves at most two fractional
documents, which meet again at the next level, until one landing per source is left.
"""

from __future__ import annotations

import base64
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.truncation import source_name
from codeloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 20_000
EPS = 1e-9

_encoders: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


SIZES = "doc_id bigint, source string, tokens bigint"


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens. The driver reads the vocabulary (about 1 MB) and broadcasts it."""
    shared = documents.sparkSession.sparkContext.broadcast(read_ranks(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        if tokenizer not in _encoders:
            _encoders[tokenizer] = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        encode = _encoders[tokenizer].encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(encode(t)) for t in batch.column(2).to_pylist()], pa.int64())], ["doc_id", "source", "tokens"])

    rows = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(run, SIZES)


def flight(pi: list[float], size: list[float], rng: random.Random, constraints: int = 2) -> list[float]:
    """Probabilities after moving them to 0 or 1 while keeping sum(pi) and, with two constraints, sum(pi * size); at most ``constraints`` stay fractional."""
    pi = list(pi)
    held: list[int] = []
    todo = [k for k, p in enumerate(pi) if EPS < p < 1 - EPS]
    at, width = 0, constraints + 1
    while True:
        while len(held) < width and at < len(todo):
            held.append(todo[at])
            at += 1
        if len(held) < width:
            return pi
        if constraints == 2:
            a, b, c = (size[k] for k in held)
            u = [b - c, c - a, a - b]  # sums to 0, and so do its products with the sizes
            if max(map(abs, u)) < EPS:
                u = [1.0, -1.0, 0.0]
        else:
            u = [1.0, -1.0]
        up = min(((1 - pi[k]) / v if v > 0 else pi[k] / -v) for k, v in zip(held, u) if v)
        down = min((pi[k] / v if v > 0 else (1 - pi[k]) / -v) for k, v in zip(held, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        for k, v in zip(held, u):
            pi[k] = min(1.0, max(0.0, pi[k] + step * v))
            if pi[k] < EPS:
                pi[k] = 0.0
            elif pi[k] > 1 - EPS:
                pi[k] = 1.0
        held = [k for k in held if 0.0 < pi[k] < 1.0]


def land(pi: list[float], size: list[float], rng: random.Random) -> list[float]:
    """The last fractional probabilities: give up the balance of tokens first, then that of the count."""
    pi = flight(pi, size, rng, 1)
    return [p if p in (0.0, 1.0) else float(rng.random() < p) for p in pi]


STATE = "doc_id bigint, source string, tokens bigint, whole bigint, pi double"


def _level(rows: DataFrame, seed: int, level: int, final: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", ignore_index=True)
        rng = random.Random(f"{seed}:{level}:{pdf['source'].iat[0]}:{pdf['chunk'].iat[0]}")
        order = list(range(len(pdf)))
        rng.shuffle(order)
        p, t = pdf["pi"].tolist(), pdf["tokens"].astype(float).tolist()
        moved = flight([p[i] for i in order], [t[i] for i in order], rng)
        if final:
            moved = land(moved, [t[i] for i in order], rng)
        out = [0.0] * len(order)
        for i, v in zip(order, moved):
            out[i] = v
        return pdf.assign(pi=out).drop(columns="chunk")

    return rows.groupBy("source", "chunk").applyInPandas(run, STATE)


def mix(documents: DataFrame, targets: DataFrame, seed: int = 11, tokenizer: str = TOKENIZER, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(uses, shares) of the largest mix.

    uses: doc_id, source, tokens, copies (1 or more). shares: source,
    target_share as given, aim (targets scaled to the sources that have
    documents), max_repeats, documents, tokens_available, uses, tokens, share.

    Sources compare in one spelling. Targets that are null, NaN or not above 0
    and sources without documents or tokens take no part; a null cap is 1 and a
    cap below 1 leaves the source out. Documents with null id, text or source
    are not used; repeated rows count once; every doc_id is a document. Empty
    tables give an empty mix. Targets are one row for each source, so the table
    of sources is read by the driver.
    """
    spark = documents.sparkSession
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("cap"))
    wanted = wanted.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & ~F.isnan("target_share") & (F.col("cap") >= 1)).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("cap").alias("cap"))
    sizes = token_sizes(documents, tokenizer).where("source is not null and tokens > 0").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("s")).select("doc_id", "s.source", "s.tokens")
    sizes = materialize(sizes, "sizes")
    held = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    plan = [r.asDict() for r in wanted.join(held, "source").collect()]
    uses_schema = "doc_id bigint, source string, tokens bigint, copies bigint"
    shares_schema = "source string, target_share double, aim double, max_repeats int, documents bigint, tokens_available bigint, uses bigint, tokens bigint, share double"
    if not plan:
        return spark.createDataFrame([], uses_schema), spark.createDataFrame([], shares_schema)
    whole_share = sum(r["target_share"] for r in plan)
    for r in plan:
        r["aim"] = r["target_share"] / whole_share
    total = min(r["cap"] * r["available"] / r["aim"] for r in plan)
    for r in plan:
        often = min(float(r["cap"]), total * r["aim"] / r["available"])
        r["whole"] = int(often + EPS)
        r["pi"] = max(0.0, often - r["whole"]) if often - r["whole"] > EPS else 0.0
    table = spark.createDataFrame([(r["source"], r["target_share"], r["aim"], r["cap"], r["documents"], r["available"], r["whole"], r["pi"]) for r in plan], "source string, target_share double, aim double, cap int, documents bigint, available bigint, whole bigint, pi double")
    rows = sizes.join(F.broadcast(table.select("source", "whole", "pi")), "source").select("doc_id", "source", "tokens", "whole", "pi")
    settled, level = rows.where("pi = 0"), 0
    open_rows, most = rows.where("pi > 0"), max([r["documents"] for r in plan if r["pi"] > 0], default=0)
    while most:
        final = most <= chunk
        parts = F.ceil(F.count(F.lit(1)) / chunk).cast("int")
        many = open_rows.groupBy("source").agg(parts.alias("parts"))
        spread = open_rows.join(F.broadcast(many), "source").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.col("parts"))).drop("parts")
        moved = materialize(_level(spread, seed, level, final), f"flight{level}")
        settled = settled.unionByName(moved.where("pi = 0 or pi = 1"))
        if final:
            break
        open_rows = moved.where("pi > 0 and pi < 1")
        most = max([r["n"] for r in open_rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()], default=0)
        level += 1
    uses = settled.select("doc_id", "source", "tokens", (F.col("whole") + F.col("pi").cast("bigint")).alias("copies")).where("copies > 0")
    got = uses.groupBy("source").agg(F.sum("copies").alias("uses"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    all_tokens = got.agg(F.sum("tokens").alias("all"))
    shares = table.join(got, "source", "left").crossJoin(F.broadcast(all_tokens)).select(
        "source", "target_share", F.round("aim", 6).alias("aim"), F.col("cap").alias("max_repeats"), "documents", F.col("available").alias("tokens_available"),
        F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("all"), 6).alias("share"),
    )
    return uses, shares
