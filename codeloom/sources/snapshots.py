"""Reading and writing saved analyses, baselines and guard manifests as versioned JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.session import read_text, swap_text

VERSION = 1


def load_analysis(spark: SparkSession, path: str, schema: str, document: bool = False) -> DataFrame:
    """A saved analysis, one issue a line; with ``document`` files that hold one JSON value each. A fixed schema, so nothing is inferred."""
    return spark.read.schema(schema).option("multiLine", document).json(path)


def save_analysis(issues: DataFrame, path: str) -> None:
    issues.write.mode("overwrite").json(path)


def _checked(spark: SparkSession, path: str) -> dict:
    text = read_text(spark, path)
    data = json.loads(text) if text else {"version": VERSION}
    if data.get("version") != VERSION:
        raise ValueError(f"{path}: version {data.get('version')} is not {VERSION}")
    return data


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    rows = [(f,) for f in _checked(spark, path).get("fingerprints", [])]
    return spark.createDataFrame(rows, "fingerprint string")


def save_baseline(baseline: DataFrame, path: str, day: str) -> None:
    """The fingerprints in order, swapped in as one file. A baseline is read whole by people and tools, so it goes through the driver."""
    prints = [r[0] for r in baseline.select("fingerprint").distinct().orderBy("fingerprint").toLocalIterator()]
    swap_text(baseline.sparkSession, path, json.dumps({"version": VERSION, "generated_at": day, "fingerprints": prints}, indent=2))


def load_guard(spark: SparkSession, path: str) -> DataFrame:
    files = _checked(spark, path).get("files", {})
    return spark.createDataFrame([(p, e["hash"], e.get("description")) for p, e in sorted(files.items())], "path string, hash string, description string")


def save_guard(manifest: DataFrame, path: str) -> None:
    rows = {r["path"]: {"hash": r["hash"]} | ({"description": r["description"]} if r["description"] else {}) for r in manifest.orderBy("path").toLocalIterator()}
    swap_text(manifest.sparkSession, path, json.dumps({"version": VERSION, "files": rows}, indent=2))


def latest_entries(entries: DataFrame) -> DataFrame:
    """The last entry of each path by (scanned_at, entry_id), of those with a hash."""
    kept = entries.where("path is not null and hash is not null")
    return kept.groupBy("path").agg(F.max_by(F.struct("entry_id", "hash", "dep_targets", "external_specs", "loc", "total_lines", "scanned_at"), F.struct("scanned_at", "entry_id")).alias("e")).select("path", "e.*")
