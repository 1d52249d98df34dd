"""Edits that remove unused exports and dependencies: planned as a table, applied on request."""

from __future__ import annotations

from collections.abc import Iterator

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import swap_text

# A declaration of the name that is exported at the start of a line; lists and defaults are left to people.
DECLARATION = r"^([\t ]*)export[\t ]+((?:async[\t ]+)?(?:const|let|var|function|class|type|interface)[\t ]+%s\b)"
EDITS = "path string, name string, status string, line bigint, before string, after string"


def strip_export(source: str, name: str) -> tuple[str, int, str, str]:
    """(status, line, before, after): the one declaration that exports the name without ``export``; ambiguous or absent names are left alone."""
    pattern = re.compile(DECLARATION % re.escape(name), re.M)
    found = list(pattern.finditer(source))
    if len(found) != 1:
        return ("ambiguous" if found else "not-found"), 0, "", ""
    line = source.count("\n", 0, found[0].start()) + 1
    before = source.split("\n")[line - 1]
    return "planned", line, before, pattern.sub(r"\1\2", before, count=1)


def plan_export_edits(unused: DataFrame, files: DataFrame) -> DataFrame:
    """path, name, status, line, before, after for unused exports (path, name)."""
    rows = unused.select("path", "name").distinct().join(files.where("source is not null").select("path", "source").dropDuplicates(["path"]), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, n, *strip_export(s, n)) for p, n, s in zip(pdf["path"], pdf["name"], pdf["source"])]
            yield pd.DataFrame(out, columns=["path", "name", "status", "line", "before", "after"])

    return rows.mapInPandas(run, EDITS)


def edited_sources(edits: DataFrame, files: DataFrame) -> DataFrame:
    """path, source of the edited files, as a DataFrame; nothing is written."""
    per_file = edits.where("status = 'planned'").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("line", "after"))).alias("m"))
    rows = files.where("source is not null").select("path", "source").dropDuplicates(["path"]).join(per_file, "path")
    lines = F.transform(F.split("source", "\n"), lambda x, i: F.coalesce(F.element_at("m", (i + 1).cast("bigint")), x))
    return rows.select("path", F.array_join(lines, "\n").alias("source"))


def write_sources(edited: DataFrame, root: str) -> int:
    """Write edited sources (path, source) below a folder, each in one step; the number of files. They pass the driver one at a time."""
    spark, n = edited.sparkSession, 0
    for row in edited.toLocalIterator():
        swap_text(spark, f"{root.rstrip('/')}/{row['path']}", row["source"])
        n += 1
    return n


def remove_dependencies(manifest: str, packages: list[str]) -> str:
    """The manifest text without the packages in ``dependencies`` and ``devDependencies``."""
    data = json.loads(manifest)
    for section in ("dependencies", "devDependencies"):
        if isinstance(data.get(section), dict):
            data[section] = {k: v for k, v in data[section].items() if k not in packages}
    return json.dumps(data, indent=2, ensure_ascii=False) + "\n"
