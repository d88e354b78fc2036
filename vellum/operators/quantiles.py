"""Exact interpolated quantiles of columns and groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here a mergeable sketch brackets each quantile, values below
the bracket are counted, and only those inside, about 8 / SKETCH of a group, are ranked: two scans and a small exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators.skew import join_on_unique

#: The sketch is off by 1 / SKETCH of a group's rows at most, a bracket reaches 4 / SKETCH to either side.
SKETCH = 1000
#: Groups of so many values are ranked whole: in them a bracket would be narrower than the ranks that interpolation needs.
SMALL = 2 * SKETCH


def finite(c: Column) -> Column:
    x = c.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def bracket(c: Column, probabilities: list[float]) -> Column:
    """Aggregate: [low, high] of every probability's bracket, one after the other."""
    ends = [min(1.0, max(0.0, p + s * 4 / SKETCH)) for p in probabilities for s in (-1, 1)]
    return F.percentile_approx(c, ends, SKETCH)


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], *by: str, heavy: list | None = None) -> DataFrame:
    """(by, <column>_q): arrays with the quantiles of the finite values of each column, linearly interpolated; a group without any has no row or NULL.

    ``heavy``: values of the single ``by`` column that hold a large share of the rows, whose brackets are then broadcast.
    """
    values = df.select(*by, *[F.when(finite(F.col(c)), F.col(c).cast("double")).alias(c) for c in columns])
    stats = values.groupBy(*by).agg(*[a for c in columns for a in (F.count(c).alias(f"{c}_n"), bracket(F.col(c), probabilities).alias(f"{c}_at"))])
    if not by:
        rows = values.crossJoin(F.broadcast(stats))
    elif len(by) == 1 and heavy:
        rows = join_on_unique(values, stats, by[0], "inner", heavy)
    else:
        cond = values[by[0]].eqNullSafe(stats[by[0]])
        for b in by[1:]:
            cond = cond & values[b].eqNullSafe(stats[b])
        rows = values.join(stats, cond)
        for b in by:
            rows = rows.drop(stats[b])
    end = lambda c, k, whole: F.when(F.col(f"{c}_n") <= SMALL, float(whole)).otherwise(F.col(f"{c}_at")[k])
    entries = [
        F.struct(F.lit(c).alias("_c"), F.lit(i).alias("_i"), F.col(c).alias("_v"), F.col(f"{c}_n").alias("_n"), end(c, 2 * i, "-inf").alias("_lo"), end(c, 2 * i + 1, "inf").alias("_hi"))
        for c in columns
        for i in range(len(probabilities))
    ]
    long = rows.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*").where("_v is not null and _v <= _hi")
    # values below the bracket become one NULL row with their count
    counted = long.groupBy(*by, "_c", "_i", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_m"), F.first("_n").alias("_n"))
    w = Window.partitionBy(*by, "_c", "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_upto", F.sum("_m").over(w)).withColumn("_before", F.col("_upto") - F.col("_m"))
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probabilities]), F.col("_i") + 1)
    spot = p * (F.col("_n") - 1)
    hit = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_upto")), F.col("_v")))
    picked = ranked.groupBy(*by, "_c", "_i").agg(hit(F.floor(spot)).alias("_a"), hit(F.ceil(spot)).alias("_b"), F.first(spot - F.floor(spot)).alias("_f"))
    value = F.col("_a") + F.when(F.col("_f") > 0, F.col("_f") * (F.col("_b") - F.col("_a"))).otherwise(0.0)
    cells = picked.withColumn("_q", value)
    each = [F.array(*[F.max(F.when((F.col("_c") == c) & (F.col("_i") == i), F.col("_q"))) for i in range(len(probabilities))]).alias(f"{c}_q") for c in columns]
    return cells.groupBy(*by).agg(*each)
