"""Session helpers: the shared work folder and tables that cut lineage."""

from __future__ import annotations

import gc
import io
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "codeloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and single machines."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent a local session gets a temporary folder;
    a cluster without the setting is refused.
    """
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not base:
        if not conf.get("spark.master", "").startswith("local") or "cluster" in conf.get("spark.master", ""):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/codeloom/{label}-{uuid.uuid4().hex[:12]}"
    sc = spark.sparkContext
    sc._codeloom_paths = [*getattr(sc, "_codeloom_paths", []), path]
    return path


def cleanup(spark: SparkSession) -> None:
    """Delete what this session wrote to the shared folder. DataFrames that still read from there can't be used afterwards."""
    for path in getattr(spark.sparkContext, "_codeloom_paths", []):
        drop_path(spark, path)
    spark.sparkContext._codeloom_paths = []
    spark.sparkContext._codeloom_shipped = False


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a location."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def drop_path(spark: SparkSession, path: str) -> None:
    fs, hpath = filesystem(spark, path)
    fs.delete(hpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = filesystem(spark, path)
    return fs.exists(hpath)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, or None where there is none."""
    fs, hpath = filesystem(spark, path)
    if not fs.exists(hpath):
        return None
    stream = fs.open(hpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one step: write beside it, then rename over it."""
    fs, tmp = filesystem(spark, f"{path}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri() if tmp.toUri().getScheme() else fs.getUri(), hadoop)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(tmp), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)


def counted_write(df: DataFrame, path: str) -> int:
    """Write a table in place of what a failed attempt may have left, and count its rows on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return seen.get["n"]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_alone(make: Callable[[], DataFrame], spark: SparkSession, label: str) -> DataFrame:
    """The table that ``make`` gives, written; tables written on the way to it are deleted, and Spark is asked to delete their shuffle files."""
    sc = spark.sparkContext
    before = list(getattr(sc, "_codeloom_paths", []))
    out = materialize(make(), label)
    made = sc._codeloom_paths[len(before) :]
    for path in made[:-1]:
        drop_path(spark, path)
    sc._codeloom_paths = [*before, made[-1]]
    free_shuffles(spark)
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Ask Spark to delete the shuffle files that nothing needs any more.

    Spark deletes them when the driver's garbage is collected, which may be
    long after they were read last.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each context, by a zip in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_codeloom_shipped", False):
        return
    home, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, f"{home.name}/{p.relative_to(home)}")
    target = f"{shared_dir(spark, 'package')}/codeloom.zip"
    fs, hpath = filesystem(spark, target)
    out = fs.create(hpath, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    sc.addPyFile(target)
    sc._codeloom_shipped = True
