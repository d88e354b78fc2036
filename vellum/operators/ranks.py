"""Rank statistics that don't sort a whole column in one task.

Mid-ranks are computed on distinct values: values with their counts are dealt to buckets between approximate quantiles, ranked
within a bucket and shifted by the rows of the buckets before. Ties of any size are one value, so no window holds more than
a bucket of distinct values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.exprs import pearson_agg
from vellum.operators.skew import HEAVY_ROWS, HEAVY_SHARE
from vellum.session import Scratch, rows_of

#: Buckets of values at least, and the rows for each of which there is one.
BUCKETS, BUCKET_ROWS = 64, 100_000
#: Distinct values whose ranks are broadcast to the rows: about 50 bytes each.
BROADCAST_VALUES = 200_000


def buckets_for(rows: int) -> int:
    return max(BUCKETS, rows // BUCKET_ROWS)


def mid_ranks(df: DataFrame, value: str, *by: str, weight: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(by, value, n, rank): each distinct non-null value with its count and its average rank among the rows of ``by``.

    With ``weight``, a row stands for so many.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], max(1000, 20 * buckets)).alias("_cuts"))
    # without ``by`` it is one row; with it, a row for each group, which Spark broadcasts only if it is small
    cut = counts.join(cuts, list(by)) if by else counts.crossJoin(F.broadcast(cuts))
    dealt = cut.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sums = dealt.groupBy(*by, "_bucket").agg(F.sum("n").alias("_m"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("n").over(inside)
    return dealt.join(offsets, [*by, "_bucket"]).withColumn("rank", F.col("_before") + upto - F.col("n") + (F.col("n") + 1) / 2.0).select(*by, value, "n", "rank")


def with_rank(df: DataFrame, value: str, *by: str, out: str = "rank") -> DataFrame:
    """``df`` with the mid-rank of ``value`` within ``by``; NULL values have none."""
    ranks = mid_ranks(df, value, *by).select(*by, F.col(value).alias("_v"), F.col("rank").alias(out))
    on = [df[b].eqNullSafe(ranks[b]) for b in by]
    cond = df[value] == ranks["_v"]
    for c in on:
        cond = cond & c
    joined = df.join(ranks, cond, "left")
    for b in by:
        joined = joined.drop(ranks[b])
    return joined.drop("_v")


def spearman(df: DataFrame, x: str, y: str, *by: str, weight: str | None = None) -> DataFrame:
    """(by, n, rho) over the rows with both values. A constant input has rho NULL (undefined, not zero). With ``weight``, a row stands for so many."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), (F.col(weight) if weight else F.lit(1)).alias("_w"))
    # distinct pairs with their counts are all that the ranks and the sums need; written once, the input is computed once
    pairs = Scratch(df.sparkSession, "pairs").keep(rows.groupBy(*by, "_x", "_y").agg(F.sum("_w").alias("_n")).where("_n > 0"))
    k = buckets_for(rows_of(pairs))
    rx = mid_ranks(pairs, "_x", *by, weight="_n", buckets=k).select(*by, "_x", F.col("rank").alias("_rx"))
    ry = mid_ranks(pairs, "_y", *by, weight="_n", buckets=k).select(*by, "_y", F.col("rank").alias("_ry"))
    joined = pairs.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    return joined.groupBy(*by).agg(F.sum("_n").alias("n"), pearson_agg(F.col("_rx"), F.col("_ry"), F.col("_n")).alias("rho"))


def rank_correlations(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by, a, b, rho) for all ordered pairs of ``columns`` over the rows where all of them are present.

    Ranks belong to distinct values. If these are few, they are broadcast and no row is shuffled; else rows meet them by value,
    those of values with a large share of the rows by a broadcast of at most HEAVY_SHARE of them for each column.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    rows = scratch.keep(df.dropna(subset=columns).select(*by, F.monotonically_increasing_id().alias("_id"), *columns))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("e")
    long = rows.select(*by, "_id", cells).select(*by, "_id", "e.*")
    keys = [*by, "_c", "_v"]
    ranks = scratch.keep(mid_ranks(long, "_v", *by, "_c", buckets=buckets_for(rows_of(rows))))
    if rows_of(ranks) <= BROADCAST_VALUES:
        wide = rows
        for i, c in enumerate(columns):
            mine = ranks.where(F.col("_c") == c).select(*[F.col(b).alias(f"_by_{b}") for b in by], "_v", F.col("rank").alias(f"_r{i}"))
            on = F.col(c).cast("double") == F.col("_v")
            for b in by:
                on = on & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
            wide = wide.join(F.broadcast(mine), on).drop("_v", *[f"_by_{b}" for b in by])
    else:
        least = max(HEAVY_ROWS, rows_of(rows) // HEAVY_SHARE)
        heavy, light = F.broadcast(ranks.where(F.col("n") >= least).drop("n")), ranks.where(F.col("n") < least).drop("n")
        met = long.join(heavy, keys).unionByName(long.join(heavy, keys, "left_anti").join(light, keys))
        wide = met.groupBy(*by, "_id").pivot("_c", columns).agg(F.first("rank")).withColumnsRenamed({c: f"_r{i}" for i, c in enumerate(columns)})
    at = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = wide.groupBy(*by).agg(*[pearson_agg(F.col(f"_r{i}"), F.col(f"_r{j}")).alias(f"_p{i}_{j}") for i, j in at])
    entries = [F.struct(F.lit(columns[x]).alias("a"), F.lit(columns[y]).alias("b"), F.col(f"_p{i}_{j}").alias("rho")) for i, j in at for x, y in {(i, j), (j, i)}]
    return sums.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value of a rank correlation by the t distribution with n - 2 degrees of freedom."""
    from vellum.functions.distributions import t_two_sided

    if n < 3:
        return 1.0
    if abs(rho) >= 1:
        return 0.0
    return t_two_sided(rho * ((n - 2) / (1 - rho * rho)) ** 0.5, n - 2)


def benjamini_hochberg(df: DataFrame, p: str, *by: str, out: str = "q") -> DataFrame:
    """``df`` with step-up false-discovery q-values: p x m / rank, made monotone from the largest down, at most 1. NULL or NaN raises.

    A family of tests is small by nature (a row per test), so its window is one task's work; families run side by side.
    """
    checked = df.withColumn(p, F.when(F.col(p).isNull() | F.isnan(p), F.raise_error(F.lit("p-values must not be missing"))).otherwise(F.col(p)))
    up = Window.partitionBy(*by).orderBy(F.col(p).asc())
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    raw = checked.withColumn("_rn", F.row_number().over(up)).withColumn("_raw", F.col(p) * m / F.col("_rn"))
    down = Window.partitionBy(*by).orderBy(F.col("_rn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(out, F.least(F.min("_raw").over(down), F.lit(1.0))).drop("_rn", "_raw")


def concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum over all pairs of points of sign(dx) sign(dy) w w', in n log n steps.

    The values of y are numbered and split by their bits, the highest first: of two points whose numbers agree in the higher bits
    and differ in this one, the sign of dy is known, and running sums over x tell the weight of those with a smaller x.
    """
    if len(x) < 2:
        return 0.0
    order = np.argsort(x, kind="stable")
    x = np.unique(x[order], return_inverse=True)[1]
    y, w, total = np.unique(y[order], return_inverse=True)[1], w[order].astype(float), 0.0
    for bit in reversed(range(int(y.max()).bit_length())):
        at = np.argsort(y >> (bit + 1), kind="stable")
        group, xs, ws, high = (y >> (bit + 1))[at], x[at], w[at], (y[at] >> bit & 1).astype(bool)
        start = np.append(True, group[1:] != group[:-1])
        run = start | np.append(True, xs[1:] != xs[:-1])
        for upper in (True, False):
            upto = np.concatenate([[0.0], np.cumsum(np.where(high == upper, ws, 0.0))[:-1]])
            begun = np.maximum.accumulate(np.where(start, upto, 0.0))  # running sums never fall
            before = upto[np.maximum.accumulate(np.where(run, np.arange(len(ws)), 0))] - begun
            mine = high != upper
            total += (-1.0 if upper else 1.0) * float((ws[mine] * before[mine]).sum())
    return total


def kendall_tau_b(df: DataFrame, x: str, y: str, *by: str, weight: str | None = None) -> DataFrame:
    """(by, n, tau) over the rows with both values; NULL if either side is constant. With ``weight``, a row stands for so many.

    Both sides are cut into buckets of their values. Pairs of points in different buckets of either side are told by how many
    points the cells hold; pairs that share a bucket are counted inside it, in n log n steps (:func:`concordance`). A value of
    very many rows is a bucket of its own, in which nothing needs counting, and points are distinct, so no task holds more than
    about 1 / BUCKETS of them.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1)).alias("w"))
    points = Scratch(df.sparkSession, "points").keep(rows.groupBy(*by, "x", "y").agg(F.sum("w").cast("double").alias("w")).where("w > 0"))
    on = list(by)
    meet = lambda a, b: a.join(b, on) if on else a.crossJoin(F.broadcast(b))
    steps = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = points.groupBy(*by).agg(F.array_distinct(F.percentile_approx("x", steps, 1000)).alias("_cx"), F.array_distinct(F.percentile_approx("y", steps, 1000)).alias("_cy"))
    bucket = lambda c, v: 2 * F.size(F.filter(c, lambda t: t < F.col(v))) + F.array_contains(c, F.col(v)).cast("int")
    dealt = Scratch(df.sparkSession, "dealt").keep(meet(points, cuts).select(*by, "x", "y", "w", bucket("_cx", "x").alias("bx"), bucket("_cy", "y").alias("by")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name in on)
    schema = f"{kinds}, s double" if on else "s double"

    def inside(left: str, right: str):
        def count(t: pa.Table) -> pa.Table:
            s = concordance(t[left].to_numpy(), t[right].to_numpy(), t["w"].to_numpy())
            return pa.Table.from_arrays([*[t[b].slice(0, 1) for b in on], pa.array([s])], names=[*on, "s"])

        return count

    several = lambda side, v: dealt.join(dealt.groupBy(*on, side).agg((F.min(v) != F.max(v)).alias("_m")).where("_m").drop("_m"), [*on, side], "left_semi")
    same_x = several("bx", "x").groupBy(*on, "bx").applyInArrow(inside("x", "y"), schema)
    same_y = several("by", "y").groupBy(*on, "by").applyInArrow(inside("bx", "y"), schema)  # those that share the other bucket are tied in it
    cells = dealt.groupBy(*on, "bx", "by").agg(F.sum("w").alias("w"))  # at most (2 BUCKETS)^2 a group
    apart = cells.groupBy(*on).applyInArrow(inside("bx", "by"), schema) if on else cells.groupBy(F.lit(1).alias("_g")).applyInArrow(inside("bx", "by"), schema)
    sums = apart.unionByName(same_x).unionByName(same_y).groupBy(*on).agg(F.sum("s").alias("s"))
    n = points.groupBy(*on).agg(F.sum("w").alias("n"))
    ties = lambda c, k: points.groupBy(*on, c).agg(F.sum("w").alias("t")).groupBy(*on).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(k))
    row = meet(meet(n, ties("x", "tx")), ties("y", "ty"))
    row = row.join(sums, on, "left") if on else row.crossJoin(F.broadcast(sums))
    pairs_all = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt(pairs_all - F.col("tx")) * F.sqrt(pairs_all - F.col("ty")))
    return row.where("n is not null").select(*on, F.col("n").cast("bigint").alias("n"), tau.alias("tau"))
