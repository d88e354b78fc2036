"""Exact ranks in a seeded hash order without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.exprs import hash_int

BUCKETS = 256


def hashed_rank(df: DataFrame, key: str, salt: str, *by: str, out: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row within ``by`` in the order of md5(salt || key), ties by ``key``, and the size of its group as ``<out>_of``.

    Rows are dealt to buckets by their leading hash bits; a window holds one bucket of one group, and buckets are shifted by
    the rows of those before. ``key`` must be unique.
    """
    dealt = df.withColumn("_h", hash_int(F.concat(F.lit(salt), F.col(key).cast("string")))).withColumn("_b", F.shiftright("_h", 24).cast("int"))
    counts = dealt.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_m"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_m").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "_b", before.alias("_before"), F.sum("_m").over(w).alias(f"{out}_of"))
    cond = dealt["_b"] == offsets["_b"]
    for c in by:
        cond = cond & dealt[c].eqNullSafe(offsets[c])
    joined = dealt.join(offsets, cond)
    for c in (*by, "_b"):
        joined = joined.drop(offsets[c])
    inside = Window.partitionBy(*by, "_b").orderBy("_h", key)
    return joined.withColumn(out, F.col("_before") + F.row_number().over(inside)).drop("_h", "_b", "_before")
