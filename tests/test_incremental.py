from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom.operators.incremental import ChangeState, content_fingerprint, digest_value, replay_runs, target_set

ENTRY = "entry_id bigint, run_id bigint, path string, hash string, dep_targets array<string>, scanned_at timestamp, arrived_at timestamp, extra string"
RUN = "run_id bigint, cutoff_at timestamp, status string"
T = lambda h: datetime(2025, 3, 1) + timedelta(hours=h)


def replay(spark, entries, runs):
    return sorted(tuple(r) for r in replay_runs(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(runs, RUN)).collect())


def brute(entries, runs):
    norm = lambda e: (e[3].lower().removeprefix("sha256:"), tuple(sorted({t for t in (e[4] or []) if t is not None})))
    out, before = set(), {}
    for run, cutoff, status in sorted(set(runs)):
        if status != "succeeded":
            continue
        state = {}
        for e in entries:
            if e[2] is not None and e[3] is not None and e[6] is not None and cutoff is not None and e[6] <= cutoff:
                key = (e[5] or datetime.min, e[0])
                if e[2] not in state or state[e[2]][0] < key:
                    state[e[2]] = (key, norm(e))
        out |= {(run, p) for p, (_, v) in state.items() if before.get(p) != v}
        before = {p: v for p, (_, v) in state.items()}
    return sorted(out)


ENTRIES = [
    (1, 1, "a", "AB12", ["x", "y"], T(0), T(1), "q"), (1, 1, "a", "AB12", ["x", "y"], T(0), T(1), "q"), (2, 2, "a", "sha256:ab12", ["y", "x", "y"], T(5), T(6), None),
    (3, 3, "a", "ab12", None, T(9), T(10), None), (4, 1, "b", None, ["x"], T(0), T(1), None), (5, 2, "b", "cc", [], T(4), T(5), None), (6, 3, "b", "cc", None, T(8), T(30), None),
    (7, 1, "c", "11", ["z", None], T(7), T(20), None), (8, 3, "c", "22", ["z"], T(7), T(20), None), (9, 1, None, "33", None, T(0), T(1), None), (10, 1, "d", "44", None, None, T(1), None), (11, 1, "e", "55", None, T(0), None, None),
]


def test_replay_matches_brute_force(spark):
    runs = [(1, T(2), "succeeded"), (2, T(6), "failed"), (3, T(7), "succeeded"), (4, T(21), "succeeded"), (5, T(40), "aborted"), (6, T(41), "succeeded"), (6, T(41), "succeeded")]
    assert replay(spark, ENTRIES, runs) == brute(ENTRIES, runs)


def test_cutoff_that_goes_back_and_null_cutoff(spark):
    runs = [(1, T(21), "succeeded"), (2, T(2), "succeeded"), (3, None, "succeeded"), (4, T(21), "succeeded")]
    assert replay(spark, ENTRIES, runs) == brute(ENTRIES, runs)


def test_empty_tables(spark):
    assert replay(spark, [], [(1, T(2), "succeeded")]) == []
    assert replay(spark, ENTRIES, []) == []


def test_failure_before_swap_repeats_nothing_and_loses_nothing(spark, tmp_path):
    state = ChangeState(spark, f"file://{tmp_path}/state")
    row = lambda k, n: spark.createDataFrame([(k, T(n), n, f"{k}{n}")], "key string, at timestamp, id bigint, h string").select("key", F.struct("at", "id").alias("ord"), F.unhex(F.md5("h")).alias("fp"))
    assert state.advance("r1", row("a", 1))
    with pytest.raises(RuntimeError):
        state.advance("r2", row("b", 2), fail_before_swap=True)
    assert state.pointer()["version"] == 1
    assert state.advance("r2", row("b", 2))
    assert [r.key for r in state.changed("r2").collect()] == ["b"]
    assert not state.advance("r2", row("b", 2))
    assert [r.key for r in state.changed("r1").collect()] == ["a"]


def test_notations(spark):
    df = spark.createDataFrame([("SHA256:00FF ",), ("0x00ff",), ("00ff",), ("sha-256=00ff",)], "h string")
    assert {r[0] for r in df.select(digest_value(F.col("h"))).collect()} == {"00ff"}
    sets = spark.createDataFrame([(["b", "a", "a", None],), (None,), ([],)], "t array<string>")
    assert [r[0] for r in sets.select(target_set(F.col("t"))).collect()] == [["a", "b"], [], []]
    assert sets.select(content_fingerprint(F.lit("x"), F.col("t")).alias("f")).distinct().count() == 2


def test_a_small_run_writes_its_own_rows_only(spark, tmp_path):
    state = ChangeState(spark, f"file://{tmp_path}/state")
    rows = lambda keys, at: spark.createDataFrame([(f"k{k:04d}", T(at), at, f"{k} {at}") for k in keys], "key string, at timestamp, id bigint, h string").select("key", F.struct("at", "id").alias("ord"), F.unhex(F.md5("h")).alias("fp"))
    held = lambda part: spark.read.parquet(f"file://{tmp_path}/state/{part}").count()
    assert state.advance("r1", rows(range(500), 1)) and state.advance("r2", rows(range(500, 1000), 2))
    base = state.pointer()["base"]
    assert state.advance("r3", rows([3, 1000], 3)) and state.advance("r4", rows([3], 2))  # the last one is late
    now = state.pointer()
    assert now["base"] == base and held("v000003") == 2 and held("v000004") == 0
    assert sorted(r.key for r in state.changed("r3").collect()) == ["k0003", "k1000"] and state.changed("r4").count() == 0
    for n in range(5, 9):
        state.advance(f"r{n}", rows(range(1000 * n, 1000 * n + 400), n))
    assert state.pointer()["base"] > base  # the deltas outgrew the base
    assert not state.advance("r3", rows([5], 9)) and state.state(state.pointer()).select("key").distinct().count() == 1001 + 4 * 400


def test_replay_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    runs = [(1, T(2), "succeeded"), (3, T(7), "succeeded"), (4, T(21), "succeeded"), (6, T(41), "succeeded")]
    root, real, done = f"file://{tmp_path}/root", ChangeState.advance, []

    def dies(self, token, rows, **more):
        done.append(token)
        return real(self, token, rows, fail_before_swap=len(done) == 3, **more)

    entries, table = spark.createDataFrame(ENTRIES, ENTRY), spark.createDataFrame(runs, RUN)
    monkeypatch.setattr(ChangeState, "advance", dies)
    with pytest.raises(RuntimeError):
        replay_runs(entries, table, root)
    assert sorted(tuple(r) for r in replay_runs(entries, table, root).collect()) == brute(ENTRIES, runs)
    assert sorted(tuple(r) for r in replay_runs(entries, table, root).collect()) == brute(ENTRIES, runs)
