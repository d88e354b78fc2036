"""Joins with the guarantees that audits of feature tables rely on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _unique(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """(keys, _n) with an error raised inside the plan, on the executors, for a key that occurs twice."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    say = F.concat(F.lit(f"key occurs more than once on the {side}: "), F.to_json(F.struct(*keys)))
    return counts.withColumn("_n", F.when(F.col("_n") > 1, F.raise_error(say).cast("bigint")).otherwise(F.col("_n")))


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that fails while it runs if a key repeats on either side. NULL keys match nothing and may repeat.

    The check is an aggregate on the join keys, so it shares its exchange with the join and is no job of its own.
    """
    clash = sorted(set(left.columns) & set(right.columns) - set(keys))
    if clash:
        raise ValueError(f"columns on both sides: {clash}")
    known = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
    checked = []
    for df, side in ((left, "left"), (right, "right")):
        counts = _unique(df.where(known), keys, side).withColumnRenamed("_n", f"_n_{side}")
        checked.append(df.join(counts, keys, "left"))
    joined = checked[0].join(checked[1], keys, how)
    # the counts must survive pruning, or the check would be optimised away
    guard = F.coalesce(F.col("_n_left"), F.lit(1)) + F.coalesce(F.col("_n_right"), F.lit(1)) > 0
    return joined.where(guard).drop("_n_left", "_n_right")


def left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which ``left``'s columns win: those of ``right`` with the same name are left out, not suffixed."""
    fresh = [c for c in right.columns if c in keys or c not in left.columns]
    return left.join(right.select(*fresh), keys, "left")


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], fill: dict[str, object]) -> DataFrame:
    return left.join(right, keys, "full").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fill.items()})


def reconcile(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status) of every key that isn't on both sides with equal values: only_left, only_right or mismatch."""
    a = left.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    status = F.when(F.col("_in_b").isNull(), "only_left").when(F.col("_in_a").isNull(), "only_right").when(~F.col("_a").eqNullSafe(F.col("_b")), "mismatch")
    return a.join(b, key, "full").select(key, status.alias("status")).where("status is not null")


def override(base: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` replaced by those of ``patch`` where a row matches and isn't NULL; ``patch`` has each key once."""
    new = patch.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    kept: list[Column] = [F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns]
    return base.join(new, keys, "left").select(*kept)


def missing_only(candidates: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't done yet: what an incremental extraction still has to do."""
    return candidates.join(done.select(*keys), keys, "left_anti")


def align(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of all frames whose key is in each of them, joined on it; row order is never a key."""
    return reduce(lambda a, b: a.join(b, key, "inner"), frames)
