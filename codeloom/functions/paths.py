"""Paths as locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def location(path: Column) -> Column:
    """The location that a path names: separators unified, empty and ``.`` segments dropped, ``..`` resolved.

    A ``..`` at the root has no effect. Null stays null, and a path without any
    segment becomes the empty string.
    """
    parts = F.filter(F.split(F.regexp_replace(F.trim(path), r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc),
    )
    return F.array_join(F.when(F.array_contains(parts, ".."), walked).otherwise(parts), "/")
