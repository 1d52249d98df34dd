import random

from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.operators import graph

EDGE = "source string, target string"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_dead_code_golden(spark, rows):
    nodes = frame(spark, [("index",), ("orphan",), ("a",), (None,)], "path string")
    edges = frame(spark, [("index", "a"), (None, "x"), ("a", "missing")], EDGE)
    loc = frame(spark, [("orphan", 45)], "path string, loc bigint")
    dead = graph.dead_code(nodes, edges, frame(spark, [("index",), ("nowhere",)], "path string"), loc)
    assert rows(dead) == [("orphan", 45, 0.95, "not reachable from any entry point")]


def test_no_entries_and_empty(spark):
    nodes, edges = frame(spark, [("a",), ("b",)], "path string"), frame(spark, [("a", "b")], EDGE)
    none = frame(spark, [], "path string")
    assert graph.dead_code(nodes, edges, none, frame(spark, [], "path string, loc bigint")).count() == 2
    assert graph.dead_code(none, frame(spark, [], EDGE), none, frame(spark, [], "path string, loc bigint")).count() == 0


def test_framework_dead(spark, rows):
    nodes = frame(spark, [(p,) for p in ("src/a.ts", "src/b.test.ts", "src/main.ts", "scripts/x.ts", "lib/y.ts")], "path string")
    dead = graph.framework_dead(nodes, frame(spark, [("src/main.ts", "src/a.ts")], EDGE), frame(spark, [("src/main.ts",)], "path string"), nodes, frame(spark, [], "path string, loc bigint"))
    assert [r[0] for r in rows(dead)] == ["scripts/x.ts"]


def test_cycles(spark, rows):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("e", "e"), ("x", "y"), ("y", "x"), ("a", "b")], EDGE)
    assert rows(graph.circular_dependencies(edges)) == [(("a", "b", "c"),), (("x", "y"),)]
    assert rows(graph.circular_dependencies(frame(spark, [("e", "e")], EDGE))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefg"), st.sampled_from("abcdefg")), max_size=20))
def test_cycles_are_real(edges):
    targets = {}
    for s, t in sorted(set(edges)):
        targets.setdefault(s, []).append(t)
    found = graph.cycles_of(targets)
    assert len(set(map(tuple, found))) == len(found)
    for c in found:
        assert c[0] == min(c) and len(c) > 1
        assert all(c[(i + 1) % len(c)] in targets[c[i]] for i in range(len(c)))


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(45)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)] + [("z", None)]
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.name: r.group for r in graph.components(frame(spark, pairs, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(frame(spark, [], "a string, b string")).count() == 0


def test_neighbourhood_and_chains(spark, rows):
    edges = frame(spark, [("a", "b"), ("b", "c"), ("d", "a")], EDGE)
    assert [r[0] for r in rows(graph.neighbourhood(edges, frame(spark, [("a",)], "path string")))] == ["a", "b", "d"]
    unused = frame(spark, [("src/a", "Foo"), ("src/a", "Bar")], "path string, name string")
    imported = frame(spark, [("top", "Foo")], "target string, name string")
    again = frame(spark, [("mid", "src/a", "*"), ("top", "mid", "Foo")], "barrel string, target string, name string")
    assert rows(graph.used_through_reexports(unused, imported, again)) == [("src/a", "Foo")]


def test_long_chains_take_few_rounds(spark):
    """A chain is merged in halves, whatever its names; spreading its least name takes more rounds."""
    n = 3000
    edges = frame(spark, [(f"{i:05}", f"{i + 1:05}") for i in range(n) if i % 1000 != 999] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x")], "a string, b string")
    got = graph.components(edges, most_rounds=12, local_edges=20)
    assert sorted(map(tuple, got.collect())) == sorted([(f"{i:05}", f"{i // 1000 * 1000:05}") for i in range(n)] + [("x", "x"), ("y", "x")])
    star = frame(spark, [("hub", f"leaf{i}") for i in range(500)], "a string, b string")
    assert {tuple(r) for r in graph.components(star, local_edges=1).collect()} == {("hub", "hub")} | {(f"leaf{i}", "hub") for i in range(500)}
