"""Joining to a per-key table when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS_MOST = 100_000


def heavy_from(total_rows: int, floor: int) -> int:
    """The count from which a key is heavy. At most ``total_rows / heavy_from`` keys reach it, so at most HEAVY_KEYS_MOST."""
    return max(floor, -(-total_rows // HEAVY_KEYS_MOST))


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, count_col: str, total_rows: int, floor: int = 200_000) -> DataFrame:
    """Inner join of ``rows`` with one row per key; rows of heavy keys don't shuffle.

    ``per_key`` holds in ``count_col`` how many of ``rows`` have the key, so
    the number of heavy keys has a proven bound and they are broadcast.
    """
    limit = heavy_from(total_rows, floor)
    if total_rows < limit:
        return rows.join(per_key.drop(count_col), key)
    heavy = per_key.where(F.col(count_col) >= limit).drop(count_col)
    light = per_key.where(F.col(count_col) < limit).drop(count_col)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))
