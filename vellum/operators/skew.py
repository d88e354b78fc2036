"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of the rows on, so there are at most HEAVY_SHARE heavy keys.
HEAVY_SHARE = 256
#: Below this many rows a key is never heavy, whatever its share.
HEAVY_ROWS = 50_000


def heavy_keys(df: DataFrame, key: str, rows: int) -> list:
    """Keys with at least ``max(HEAVY_ROWS, rows / HEAVY_SHARE)`` rows: at most HEAVY_SHARE values by construction."""
    if rows < HEAVY_ROWS:
        return []
    least = max(HEAVY_ROWS, rows // HEAVY_SHARE)
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return [r[0] for r in counts.where(F.col("_n") >= least).collect()]


def join_on_unique(left: DataFrame, right: DataFrame, key: str, how: str, heavy: list) -> DataFrame:
    """Join ``left`` to ``right``, which holds each ``key`` once.

    Rows of heavy keys meet a broadcast of at most ``len(heavy)`` right rows and are never shuffled;
    all others take the shuffled join. A NULL key matches nothing, as in SQL.
    """
    if not heavy:
        return left.join(right, key, how)
    # NULL keys go the shuffled way: NULL isn't in any list, and 'not in' of NULL is NULL
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(heavy)))
    return left.where(~is_heavy).join(right, key, how).unionByName(left.where(is_heavy).join(few, key, how))
