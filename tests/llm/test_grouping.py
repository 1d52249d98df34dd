"""Top-n, hash-to-min, spans and near duplicates against brute force on small tables."""

import math
import random
import re

from pyspark.sql import functions as F

from codeloom.llm.groups import hash_to_min, linked_groups
from codeloom.llm.neardup import near_duplicate_groups, near_duplicate_pairs, shingle_set
from codeloom.llm.spans import chain_matches, fuzzy_passages, shared_share, shared_spans
from codeloom.llm.topn import score_bucket, top_n

ISSUES = "file string, impact double, confidence double, issue_id bigint, grp string, score string, rank int"


def issue_rows(rng, n):
    out = []
    for i in range(n):
        file = rng.choice(["hot"] * 6 + ["a", "b", None, "c"])
        impact = rng.choice([0.0, -0.0, 1.0, 1.0, 5.0, -2.5, 1e300, 5e-324, float("inf"), float("-inf"), float("nan"), None])
        out.append((file, impact, rng.choice([0.5, 0.9, None]), i, "x", "y", 1))
    return out + out[: n // 3] + [("only", 1.0, None, 10_000, "x", "y", 1), ("hot", 2.0, 1.0, None, "x", "y", 1)]


def brute_top(rows, n):
    out, groups = set(), {}
    for f, i, c, k, *_ in set(rows):
        if f is not None and k is not None and i is not None and not math.isnan(i):
            groups.setdefault(f, set()).add((-i, c is None, -(c or 0), k))
    for f, g in groups.items():
        out |= {(f, x[3]) for x in sorted(g)[:n]}
    return out


def test_top_n_matches_brute_force(spark):
    rows = issue_rows(random.Random(5), 400)
    df = spark.createDataFrame(rows, ISSUES)
    for floor in (2, 10_000):
        got = {(r.grp, r.id) for r in top_n(df, "file", "impact", "confidence", "issue_id", 3, floor).collect()}
        assert got == brute_top(rows, 3)
    assert top_n(spark.createDataFrame([], ISSUES), "file", "impact", "confidence", "issue_id").count() == 0


def test_buckets_follow_the_order(spark):
    values = sorted([0.0, 1e-320, 1e-5, 0.3, 1.0, 1.04, 2.0, 1e9, float("inf"), -1e-320, -1.0, -7.0, float("-inf")])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    buckets = [r[0] for r in df.select(score_bucket(F.col("v")), "v").orderBy("v").collect()]
    assert buckets == sorted(buckets)


def components(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_hash_to_min(spark):
    rng = random.Random(9)
    pairs = [(f"v{rng.randrange(80):03d}", f"v{rng.randrange(80):03d}") for _ in range(60)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(30)] + [("hub", f"s{i:03d}") for i in range(40)] + [("x", None), (None, None), ("y", "y")]
    df = spark.createDataFrame(pairs + pairs[:20], "a string, b string")
    for floor in (10, 200_000):  # with and without heavy vertices
        assert {r["name"]: r["group"] for r in hash_to_min(df, floor).collect()} == components(pairs)
    assert hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def test_links_compare_locations(spark):
    rows = [("a/x.ts", "./a//y.ts", 0.4), ("a\\y.ts", "a/./z.ts", -0.1), ("a/x.ts", "./a/x.ts", 0.0), ("a/x.ts", "q", float("nan")), ("a/x.ts", "r", None), ("a/x.ts", "s", 0.41), (None, "t", 0.1)]
    got = {(r.path, r.group_path) for r in linked_groups(spark.createDataFrame(rows, "path_a string, path_b string, distance double")).collect()}
    assert got == {("a/x.ts", "a/x.ts"), ("a/y.ts", "a/x.ts"), ("a/z.ts", "a/x.ts")}


BLOCKS = "block_id bigint, path string, start_line bigint, source string, pos string, key string, class string"


def span_blocks(rng):
    pool = [f"line {i}" for i in range(14)]
    shared = [f"shared {i}" for i in range(9)]
    out = []
    for i in range(30):
        lines = rng.choices(pool, k=rng.randrange(1, 12))
        if rng.random() < 0.6:
            a = rng.randrange(0, 4)
            lines += shared[a : a + rng.randrange(4, 9)] + rng.choices(pool, k=3)
        out.append((i, f"f{i % 11}", 10 + i, "\n".join(lines), "p", "k", "c"))
    copy = "\n".join(shared)
    out += [(100 + i, f"f{i % 3}", 1, copy, "p", "k", "c") for i in range(12)]
    return out + out[:5] + [(200, None, 1, copy, "p", "k", "c"), (201, "n", None, copy, "p", "k", "c"), (202, "n", 1, None, "p", "k", "c"), (203, "n", 1, "", "p", "k", "c")]


def brute_spans(rows, k=6):
    rows = [r for r in set(rows) if None not in r[:4]]
    where = {}
    for i, p, s, t, *_ in rows:
        lines = t.split("\n")
        for a in range(len(lines) - k + 1):
            where.setdefault("\n".join(lines[a : a + k]), set()).add(p)
    out = set()
    for i, p, s, t, *_ in rows:
        lines = t.split("\n")
        hit = set()
        for a in range(len(lines) - k + 1):
            if where["\n".join(lines[a : a + k])] - {p}:
                hit |= set(range(a, a + k))
        for a in hit:
            if a - 1 not in hit:
                b = a
                while b + 1 in hit:
                    b += 1
                out.add((i, s + a, s + b))
    return out


def test_shared_spans(spark):
    rows = span_blocks(random.Random(2))
    df = spark.createDataFrame(rows, BLOCKS)
    want = brute_spans(rows)
    assert want
    assert {(r.block_id, r.first_line, r.last_line) for r in shared_spans(df).collect()} == want
    assert {(r.block_id, r.first_line, r.last_line) for r in shared_spans(df, heavy_floor=5).collect()} == want
    share = {r.block_id: r.shared_lines for r in shared_share(df).collect()}
    assert all(share[i] == sum(b - a + 1 for j, a, b in want if j == i) for i in share)
    assert shared_spans(spark.createDataFrame([], BLOCKS)).count() == 0


def test_chains_hold_every_match_once_and_in_order():
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randrange(1, 25)
        pos, other = [rng.randrange(30) for _ in range(n)], [rng.randrange(30) for _ in range(n)]
        chains = chain_matches(pos, other)
        assert sorted(m for c in chains for m in c) == list(range(n))
        for c in chains:
            assert all(pos[a] < pos[b] and other[a] < other[b] for a, b in zip(c, c[1:]))
    assert chain_matches([0, 1, 2, 6, 7], [5, 6, 7, 11, 12]) == [[0, 1, 2, 3, 4]]


def test_fuzzy_passage_spans_an_edit(spark):
    a = [f"a {i}" for i in range(16)]
    b = a[:7] + ["edited"] + a[8:]
    df = spark.createDataFrame([(1, "x", 1, "\n".join(a)), (2, "y", 1, "\n".join(b))], "block_id bigint, path string, start_line bigint, source string")
    got = [r for r in fuzzy_passages(df).collect() if r.block_id == 1]
    assert [(r.first_line, r.last_line, r.exact_lines, r.equal_lines) for r in got] == [(1, 16, 15, 15)]


def tokens(t):
    return re.findall(r"[A-Za-z0-9_$]+|[^\sA-Za-z0-9_$]", t)


def test_passages_with_every_block(spark):
    a = [f"line {i}" for i in range(30)]
    b = a[:14] + ["edited"] + a[15:]
    c = ["own"] * 3 + a[4:12] + ["more"] * 3  # takes the windows in the middle of a and b
    texts = [(1, "k/a.ts", a), (2, "k/b.ts", b), (3, "a/c.ts", c), (4, "z/c.ts", c), (5, "k/a.ts", a[2:10])]
    got = {tuple(r) for r in fuzzy_passages(spark.createDataFrame([(i, p, 1, "\n".join(t)) for i, p, t in texts], "block_id bigint, path string, start_line bigint, source string")).collect()}
    assert (1, 1, 30, 2, 1, 30, 29, 29) in got and (2, 1, 30, 1, 1, 30, 29, 29) in got
    assert {(1, 5, 12, 3, 4, 11, 8, 8), (3, 4, 11, 2, 5, 12, 8, 8), (4, 4, 11, 1, 5, 12, 8, 8), (3, 1, 14, 4, 1, 14, 14, 14), (5, 1, 8, 2, 3, 10, 8, 8)} <= got
    assert not {(1, 5), (5, 1)} & {(r[0], r[3]) for r in got} and {(5, 3), (3, 5), (4, 5)} <= {(r[0], r[3]) for r in got}


def test_near_duplicates(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(25):
        base = rng.choices(words, k=30)
        for j in range(3):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i * 10 + j, f"f{(i + j) % 7}", " ".join(text)))
    rows += [(500 + i, f"g{i % 2}", "same ( text ) here ;") for i in range(6)]
    rows += rows[:4] + [(900, None, "a b c"), (901, "p", None), (902, "p", ""), (903, "p", "a b")]
    sets = {(i, p): {tuple(tokens(t)[k : k + 3]) for k in range(len(tokens(t)) - 2)} for i, p, t in rows if p and t}
    want = set()
    for (i, p), a in sets.items():
        for (j, q), b in sets.items():
            if i < j and p != q and a and b and len(a & b) >= 0.7 * len(a | b):
                want.add((i, j))
    df = spark.createDataFrame([(*r, "c", "b") for r in rows], "block_id bigint, path string, source string, class string, bucket string")
    assert {(r.block_a, r.block_b) for r in near_duplicate_pairs(df).collect()} == want and want
    groups = {r.block_id: r.group_id for r in near_duplicate_groups(df).collect()}
    assert all(groups[i] == groups[j] for i, j in want) and len(groups) == len({i for i, _ in sets if len(sets[i, _])})
    assert near_duplicate_pairs(df.limit(0)).count() == 0


def test_shingle_sets_count_like_token_runs():
    text = "function a ( b ) { return a ( b ) ; }"
    assert len(shingle_set(text)) == len({tuple(tokens(text)[k : k + 3]) for k in range(len(tokens(text)) - 2)})
