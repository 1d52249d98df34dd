"""Watching a folder of snapshots: changed files go into the fact cache, then the batch queries run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.facts import FACTS, FactCache
from codeloom.sources.scan import is_skipped

SNAPSHOT = "path string, language string, source string, changed_at timestamp"
RELEVANT = r"\.(ts|tsx|js|jsx|rs|py|json|toml)$"


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of file versions: one row for each version, a null source for a removed file. Irrelevant paths are dropped."""
    rows = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1000).parquet(folder)
    return rows.where(F.col("path").rlike(RELEVANT) & ~is_skipped(F.col("path")))


def newest(rows: DataFrame) -> DataFrame:
    """The newest version of each path; of equal times the greater text."""
    return rows.groupBy("path").agg(F.max(F.struct("changed_at", "source", "language")).alias("v")).select("path", "v.language", "v.source", "v.changed_at")


class Watcher:
    """Keeps the current files in versions of a table and calls ``on_change`` (files, facts) after every batch with changes.

    A batch that is repeated after a failure merges to the same table, so it has no further effect.
    """

    def __init__(self, spark: SparkSession, root: str, on_change: Callable[[DataFrame, DataFrame], None]):
        self.spark, self.root, self.on_change = spark, root, on_change
        self.cache = FactCache(spark, f"{root}/cache")

    def files(self, batch: int) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/files{batch % 2}")

    def apply(self, changes: DataFrame, batch: int) -> None:
        now = newest(changes)
        if batch:
            now = newest(self.files(batch - 1).unionByName(now.select("path", "language", "source", "changed_at")))
        now.select("path", "language", "source", "changed_at").write.mode("overwrite").parquet(f"{self.root}/files{batch % 2}")
        live = self.files(batch).where("source is not null")
        self.on_change(live, self.cache.refresh(live))

    def start(self, folder: str, once: bool = False) -> StreamingQuery:
        writer = snapshots(self.spark, folder).writeStream.option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(self.apply)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def empty_facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FACTS)
