"""Processing only new or changed records, with a versioned state that is swapped in one step.

The state holds, per key, the order and fingerprint of the latest record seen
by the last successful run. It is a base and the deltas of the runs since. A run
reads only the records that became visible since the last one, looks their keys
up in the state and writes a delta: the keys whose latest record moved, marked
where the fingerprint is new or different. While the new keys are few (a checked
number, and a small part of the state) they are broadcast, so the state is scanned
but neither shuffled nor written again; when the deltas have outgrown the base, they are merged into a new
one, so writing stays in proportion to what changed. A small pointer file names
the parts in force and is renamed last. A run that dies before the rename leaves
the old state in force, so the next run selects the same records again; a run
that is repeated after the rename is recognised by its token.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import counted_write, drop_path, read_text, shared_dir, swap_text


def digest_value(col: Column) -> Column:
    """A digest as a value: case, blanks, an algorithm prefix and ``0x`` are notation only."""
    return F.regexp_replace(F.lower(F.trim(col)), r"^(?:[a-z]+-?[0-9]+[:=])?(?:0x)?", "")


def target_set(col: Column) -> Column:
    """The canonical form of a set kept as an array; null is the empty set, null elements are dropped."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(col, lambda x: x.isNotNull()))), F.array().cast("array<string>"))


def content_fingerprint(digest: Column, targets: Column) -> Column:
    """128 bits over the digest value and the target set."""
    return F.unhex(F.md5(F.concat_ws("\x01", digest_value(digest), F.concat_ws("\x00", target_set(targets)))))


KEYS_BROADCAST, FEW = 200_000, 20  # new rows are broadcast up to this number, and while the state has FEW times as many
MOST_DELTAS = 64
STATE = "key string, ord struct<at:timestamp,id:bigint>, fp binary, changed boolean"


class ChangeState:
    """Versioned key → (order, fingerprint) state in a folder.

    ``root/CURRENT`` names the base and the deltas in force, and the version
    that each run made. ``v…`` holds the delta of a run, ``b…`` a base.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def pointer(self) -> dict:
        text = read_text(self.spark, f"{self.root}/CURRENT")
        return json.loads(text) if text else {"version": 0, "token": None, "runs": {}, "base": 0, "base_rows": 0, "deltas": []}

    def _delta(self, n: int) -> str:
        return f"{self.root}/v{n:06d}"

    def _base(self, n: int) -> str:
        return f"{self.root}/b{n:06d}"

    def state(self, now: dict) -> DataFrame | None:
        """The rows of the base and the deltas in force; of a key with several the greatest counts."""
        paths = ([self._base(now["base"])] if now["base"] else []) + [self._delta(n) for n, _ in now["deltas"]]
        return self.spark.read.schema(STATE).parquet(*paths).select("key", "ord", "fp") if paths else None

    def _merge(self, now: dict, path: str) -> int:
        entry = F.max(F.struct("ord", "fp")).alias("e")
        merged = self.state(now).groupBy("key").agg(entry).select("key", "e.ord", "e.fp", F.lit(False).alias("changed"))
        return counted_write(merged, path)

    def advance(self, token: str, rows: DataFrame, *, rebuild: bool = False, fail_before_swap: bool = False) -> bool:
        """Merge ``rows`` (key, ord, fp) and swap the pointer; False if the token was already applied.

        With ``rebuild`` the rows are the whole of what the run can see and keys
        without a row leave the state. ``fail_before_swap`` is for tests.
        """
        now = self.pointer()
        if token in now["runs"]:
            return False
        n = now["version"] + 1
        both = rows.select("key", "ord", "fp", F.lit(False).alias("old"))
        state = self.state(now)
        if state is not None:
            held = now["base_rows"] + sum(k for _, k in now["deltas"])
            if not rebuild and (n_rows := rows.count()) <= KEYS_BROADCAST and FEW * n_rows <= held:
                state = state.join(F.broadcast(rows.select("key").distinct()), "key", "left_semi")
            both = both.unionByName(state.withColumn("old", F.lit(True)))
        entry = F.struct("ord", "fp")
        met = both.groupBy("key").agg(F.max(F.when(~F.col("old"), entry)).alias("new"), F.max(F.when(F.col("old"), entry)).alias("was")).where("new is not null")
        moved = met if rebuild else met.where("was is null or new > was")
        delta = moved.select("key", "new.ord", "new.fp", (~F.col("new.fp").eqNullSafe(F.col("was.fp"))).alias("changed"))
        written = counted_write(delta, self._delta(n))
        nxt = now | {"version": n, "token": token, "runs": now["runs"] | {token: n}, "deltas": [*now["deltas"], [n, written]]}
        if rebuild:
            nxt |= {"base": 0, "base_rows": 0, "deltas": [[n, written]]}
        elif sum(k for _, k in nxt["deltas"]) > nxt["base_rows"] and len(nxt["deltas"]) > 1 or len(nxt["deltas"]) > MOST_DELTAS:
            nxt |= {"base": n, "base_rows": self._merge(nxt, self._base(n)), "deltas": []}
        if fail_before_swap:
            raise RuntimeError("run failed before its state was swapped")
        swap_text(self.spark, f"{self.root}/CURRENT", json.dumps(nxt))
        if now["base"] and nxt["base"] != now["base"]:
            drop_path(self.spark, self._base(now["base"]))
        return True

    def changed(self, token: str) -> DataFrame:
        """The keys that the run with this token found new or changed."""
        return self.spark.read.schema(STATE).parquet(self._delta(self.pointer()["runs"][token])).where("changed").select("key")


def stage_entries(entries: DataFrame, cutoffs: list, path: str) -> DataFrame:
    """Fingerprint all entries once and lay them out by the first cutoff that sees them.

    ``cutoffs`` are the distinct cutoffs of the runs, ascending: one per run
    at most, so the expression below is bounded by the number of runs.
    """
    slot = F.lit(None).cast("int")
    for i in range(len(cutoffs) - 1, -1, -1):
        slot = F.when(F.col("arrived_at") <= F.lit(cutoffs[i]), F.lit(i)).otherwise(slot)
    staged = (
        entries.where(F.col("path").isNotNull() & F.col("hash").isNotNull() & F.col("arrived_at").isNotNull())
        .select(
            F.col("path").alias("key"),
            F.struct(F.col("scanned_at").alias("at"), F.col("entry_id").alias("id")).alias("ord"),
            content_fingerprint(F.col("hash"), F.col("dep_targets")).alias("fp"),
            slot.alias("slot"),
        )
        .where(F.col("slot").isNotNull())
    )
    staged.write.mode("overwrite").partitionBy("slot").parquet(path)  # a run that died while or after it wrote this starts again
    return entries.sparkSession.read.schema("key string, ord struct<at:timestamp,id:bigint>, fp binary, slot int").parquet(path)


def replay_runs(entries: DataFrame, runs: DataFrame, root: str | None = None) -> DataFrame:
    """New or changed paths of each succeeded run, by running the state machine over the recorded runs.

    entries: path, hash, dep_targets, scanned_at, entry_id, arrived_at;
    runs: run_id, cutoff_at, status. Result: run_id, path.

    A path's state at a run is its entry with the greatest (scanned_at,
    entry_id) among those with a hash that arrived by the cutoff; a null
    ``scanned_at`` ranks lowest. Failed and aborted runs advance nothing.
    Rows without path, hash or arrival are never seen. Empty tables give an
    empty result. Duplicate rows change nothing; extra columns are ignored.
    A succeeded run without cutoff sees nothing. A cutoff that lies before
    the previous run's rebuilds the state from what that cutoff can see.
    Called again with the same ``root`` after a failure it goes on where it stopped.
    The list of runs (one small row per run ever made) is read by the driver.
    """
    spark = entries.sparkSession
    done = runs.where(F.lower(F.trim(F.col("status"))) == "succeeded").where(F.col("run_id").isNotNull())
    done = done.groupBy("run_id").agg(F.max("cutoff_at").alias("cutoff_at")).orderBy("run_id").collect()
    cutoffs = sorted({r.cutoff_at for r in done if r.cutoff_at is not None})
    out_schema = "run_id bigint, path string"
    if not cutoffs:
        return spark.createDataFrame([], out_schema)
    root = root or shared_dir(spark, "changes")
    staged = stage_entries(entries, cutoffs, f"{root}/staged")
    state, seen, result = ChangeState(spark, f"{root}/state"), -1, None
    for run in done:
        upto = cutoffs.index(run.cutoff_at) if run.cutoff_at is not None else -1
        back = upto < seen
        rows = staged.where((F.col("slot") <= upto) & (F.col("slot") > (-1 if back else seen)))
        state.advance(str(run.run_id), rows, rebuild=back)
        seen = upto
        part = state.changed(str(run.run_id)).select(F.lit(run.run_id).cast("bigint").alias("run_id"), F.col("key").alias("path"))
        result = part if result is None else result.unionByName(part)
    drop_path(spark, f"{root}/staged")
    return result
