"""Bootstraps, permutations and subset studies with portable draws.

Draws come from hashes of (salt, draw, slot), so they are the same in every engine and on every cluster. Rows are never copied
once per draw where sums will do: a cluster bootstrap reads the data once and evaluates all draws on per-cluster sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import md5
from vellum.functions.exprs import hash_int, hash_uniform, pearson_agg
from vellum.operators import held
from vellum.operators.ranks import kendall_tau_b, spearman
from vellum.session import Scratch, rows_of

#: The cluster bootstrap of rank correlations keeps sums per cluster triple: 50 clusters are 3 x 125,000 numbers. More clusters take
#: a weighted ranking of each draw instead.
MOST_CLUSTERS = 50
BUCKETS = 64
#: Rows beyond those wanted that a draw's bound lets pass: so many deviations, and so many more.
DEVIATIONS, MORE = 8, 16


def cluster_draws(spark: SparkSession, clusters: DataFrame, draws: int, salt: str) -> DataFrame:
    """(draw, cluster, mult): each draw takes as many clusters as there are, with replacement; slot s takes the hash of salt:draw:s modulo their number."""
    numbered = clusters.distinct().withColumn("idx", F.row_number().over(Window.orderBy("cluster")) - 1)
    count = clusters.agg(F.countDistinct("cluster").alias("k"))
    slots = spark.range(draws).toDF("draw").crossJoin(F.broadcast(count)).select("draw", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("slot"))
    picked = slots.select("draw", (hash_int(F.concat_ws(":", F.lit(salt), "draw", "slot")) % F.col("k")).alias("idx"))
    return picked.join(numbered, "idx").groupBy("draw", "cluster").agg(F.count(F.lit(1)).alias("mult"))


def cluster_bootstrap_mean(df: DataFrame, value: str, cluster: str, draws: int, salt: str = "mean") -> DataFrame:
    """(draw, mean): means of resampled clusters from one sum and count per cluster."""
    sums = df.where(F.col(value).isNotNull() & F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    taken = cluster_draws(df.sparkSession, sums.select("cluster"), draws, salt).join(sums, "cluster")
    return taken.groupBy("draw").agg((F.sum(F.col("mult") * F.col("s")) / F.sum(F.col("mult") * F.col("n"))).alias("mean"))


def _rows_below(df: DataFrame, value: str, cluster: str, names: list) -> DataFrame:
    """(value, below): for each distinct value, the rows (``n`` each) of each cluster below it plus half of those equal to it, as an array."""
    counts = df.groupBy(value).pivot(cluster, names).agg(F.sum("n"))
    cols = [f"_c{i}" for i in range(len(names))]
    counts = counts.select(value, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(c) for n, c in zip(names, cols, strict=True)])
    cuts = counts.agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("_cuts"))
    dealt = counts.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_b").agg(*[F.sum(c).alias(c) for c in cols])  # at most BUCKETS rows
    offsets = sums.select("_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o{c}") for c in cols])
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    below = F.array(*[(F.col(f"_o{c}") + F.sum(c).over(inside) - F.col(c) / 2.0).cast("double") for c in cols])
    return dealt.join(F.broadcast(offsets), "_b").select(value, below.alias("below"))


def cluster_bootstrap_spearman(df: DataFrame, x: str, y: str, cluster: str, draws: np.ndarray | int, salt: str = "rho") -> DataFrame:
    """(draw, rho) of the rank correlation of resampled clusters, NULL where a resample is constant.

    A row's mid-rank in a resample is the sum over clusters of multiplicity x (rows below + half the ties) plus one half, so all
    moments of the ranks are forms in the multiplicities whose coefficients are sums over rows. They are summed once; every
    draw is then a few small matrix products, and 2000 draws cost no more passes than one.
    """
    spark = df.sparkSession
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(cluster).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(cluster).alias("c"))
    # distinct points with their counts are all that is needed; written once, the input is computed once
    rows = Scratch(spark, "points").keep(rows.groupBy("x", "y", "c").agg(F.count(F.lit(1)).alias("n")))
    names = [r["c"] for r in rows.select("c").distinct().orderBy("c").limit(MOST_CLUSTERS + 1).collect()]
    if len(names) > MOST_CLUSTERS:
        if not isinstance(draws, int):
            raise ValueError("given multiplicities are for at most MOST_CLUSTERS clusters")
        taken = cluster_draws(spark, rows.select(F.col("c").alias("cluster")), draws, salt).withColumnRenamed("cluster", "c")
        weighed = rows.join(taken, "c").withColumn("w", F.col("n") * F.col("mult"))
        return spark.range(draws).toDF("draw").join(spearman(weighed, "x", "y", "draw", weight="w").select("draw", "rho"), "draw", "left")
    k = len(names)
    if not k:
        return spark.createDataFrame([], "draw bigint, rho double")
    if isinstance(draws, int):
        listed = cluster_draws(spark, rows.select(F.col("c").alias("cluster")), draws, salt).collect()  # draws x clusters numbers
        mult = np.zeros((draws, k))
        at = {n: i for i, n in enumerate(names)}
        for r in listed:
            mult[r["draw"], at[r["cluster"]]] = r["mult"]
    else:
        mult = draws
    ranked = rows.join(_rows_below(rows, "x", "c", names).withColumnRenamed("below", "bx"), "x").join(_rows_below(rows, "y", "c", names).withColumnRenamed("below", "by"), "y")
    index = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("c")) - 1
    schema = "part binary"

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((k, 3, k + 1, k + 1))
        for pdf in batches:
            if not len(pdf):
                continue
            one = np.ones((len(pdf), 1))
            bx, by = np.hstack([np.stack(pdf["bx"]), one]), np.hstack([np.stack(pdf["by"]), one])
            w, c = pdf["n"].to_numpy(float)[:, None], pdf["i"].to_numpy()
            for i in range(k):
                m = c == i
                if m.any():
                    out[i, 0] += bx[m].T @ (w[m] * bx[m])
                    out[i, 1] += by[m].T @ (w[m] * by[m])
                    out[i, 2] += bx[m].T @ (w[m] * by[m])
        yield pd.DataFrame({"part": [out.tobytes()]})

    # a part is 24 k^3 bytes; parts are added up on the executors, a few at a time
    parts = ranked.select("n", "bx", "by", index.alias("i")).mapInPandas(sums, schema)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(k * 3 * (k + 1) * (k + 1))
        for pdf in batches:
            for b in pdf["part"]:
                out += np.frombuffer(b)
        yield pd.DataFrame({"part": [out.tobytes()]})

    total = np.zeros((k, 3, k + 1, k + 1))
    for r in parts.repartition(8).mapInPandas(add, schema).collect():
        total += np.frombuffer(r["part"]).reshape(total.shape)
    result = []
    for d, m in enumerate(mult):
        s = np.einsum("i,iabc->abc", m, total)
        v = np.append(m, 0.5)
        n = s[0, k, k]
        sx, sy = s[0, k] @ v, s[1, k] @ v
        xx, yy, xy = v @ s[0] @ v - sx * sx / n, v @ s[1] @ v - sy * sy / n, v @ s[2] @ v - sx * sy / n
        flat = xx <= 1e-9 * n**3 or yy <= 1e-9 * n**3
        result.append((d, None if flat else float(xy / np.sqrt(xx * yy))))
    return spark.createDataFrame(result, "draw bigint, rho double")


def percentile_interval(draws: DataFrame, statistic: str, *by: str, level: float = 0.95) -> DataFrame:
    """(by, n_draws, low, high) of the draws for which the statistic is defined."""
    a = (1 - level) / 2
    q = F.percentile(statistic, [a, 1 - a])
    return draws.where(F.col(statistic).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n_draws"), q[0].alias("low"), q[1].alias("high"))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) multiplicity of a uniform number by inversion; up to 13, as 32 bits of a hash tell no rarer ones."""
    out, term, cumulated = F.lit(0), 0.36787944117144233, 0.36787944117144233
    for k in range(1, 14):
        out = F.when(u >= cumulated, k).otherwise(out) if k > 1 else F.when(u >= cumulated, 1).otherwise(0)
        term /= k
        cumulated += term
    return out


def iid_bootstrap_mean_difference(df: DataFrame, key: str, value: str, first: Column, draws: int, salt: str = "iid") -> DataFrame:
    """(draw, difference) of the means of rows that meet ``first`` and the others, rows weighted Poisson(1) per draw.

    Draws are exploded inside the scan and summed before the exchange, which carries a row per draw and task.
    """
    rows = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v"), first.alias("g"))
    long = rows.select(key, "v", "g", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    w = poisson_weight(hash_uniform(F.concat_ws(":", F.lit(salt), "draw", key)))
    sums = long.withColumn("w", w).groupBy("draw").agg(*[F.sum(F.when(F.col("g") == g, c)).alias(n) for g, n, c in ((True, "s1", F.col("w") * F.col("v")), (True, "n1", F.col("w")), (False, "s0", F.col("w") * F.col("v")), (False, "n0", F.col("w")))])
    return sums.select(F.col("draw").cast("bigint").alias("draw"), (F.try_divide("s1", "n1") - F.try_divide("s0", "n0")).alias("difference"))


def iid_bootstrap_correlations(df: DataFrame, key: str, x: str, y: str, draws: int, salt: str = "iid") -> DataFrame:
    """(statistic, draw, value): rank correlation (rho), Pearson's r and Kendall's tau-b of rows weighted Poisson(1) per draw.

    Rows without both values take no part. Tasks hold up to ``held.HELD_POINTS`` rows and draw by draw sum over arrays; beyond that,
    draws are exploded inside the scan and summed over equal points before the exchange.
    """
    suffix = F.concat_ws(":", F.lit(""), key)  # what follows salt:draw
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(suffix.alias("suffix"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = Scratch(df.sparkSession, "rows").keep(rows)
    if rows_of(rows) <= held.HELD_POINTS:
        return held.bootstrap_correlations(rows, draws, salt)
    long = rows.select("suffix", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    w = poisson_weight(hash_uniform(F.concat(F.lit(f"{salt}:"), F.col("draw").cast("string"), "suffix")))
    points = Scratch(df.sparkSession, "draws").keep(long.withColumn("w", w).where("w > 0").groupBy("draw", "x", "y").agg(F.sum("w").alias("w")))
    rho = spearman(points, "x", "y", "draw", weight="w").select(F.lit("rho").alias("statistic"), "draw", F.col("rho").alias("value"))
    r = points.groupBy("draw").agg(pearson_agg(F.col("x"), F.col("y"), F.col("w")).alias("value")).select(F.lit("r").alias("statistic"), "draw", "value")
    tau = kendall_tau_b(points, "x", "y", "draw", weight="w").select(F.lit("tau").alias("statistic"), "draw", F.col("tau").alias("value"))
    return rho.unionByName(r).unionByName(tau)


def permuted_levels(df: DataFrame, key: str, block: str, level: str, salt: str) -> DataFrame:
    """``df`` with ``permuted``: within each block, levels are dealt anew in a seeded hash order; the multiset of levels stays.

    A block holds the levels of one unit, a handful of rows by design.
    """
    w = Window.partitionBy(block)
    shuffled = F.row_number().over(w.orderBy(hash_int(F.concat(F.lit(salt), F.col(key).cast("string"))), key))
    plain = F.row_number().over(w.orderBy(key))
    at = df.withColumn("_to", shuffled)
    source = df.select(block, F.col(level).alias("permuted"), plain.alias("_to"))
    return at.join(source, [block, "_to"]).drop("_to")


def subset_draws(df: DataFrame, unit: str, size: int, draws: int, salt: str) -> DataFrame:
    """(draw, unit): in each draw the ``size`` units with the least hash, without replacement. Units are few: raters, clusters."""
    units = df.select(unit).where(F.col(unit).isNotNull()).distinct()
    long = units.crossJoin(F.broadcast(df.sparkSession.range(draws).toDF("draw")))
    h = hash_int(F.concat_ws(":", F.lit(salt), "draw", F.col(unit).cast("string")))
    return long.withColumn("_k", F.row_number().over(Window.partitionBy("draw").orderBy(h, unit))).where(F.col("_k") <= size).drop("_k")


def first_of_draws(df: DataFrame, key: str, by: str, wanted: dict[str, int], there: dict[str, int], draws: int, salt: str) -> DataFrame:
    """(draw, by, x, y, rank) of the ``wanted`` rows of each group that come first in each draw, in the order of md5(salt || draw:key), ties by key.

    ``there`` are the rows of each group; groups with fewer than are wanted give all of theirs. Rows are hashed where they are, once
    for each draw, and only hashes below a bound go on: about ``wanted`` and DEVIATIONS beyond of each group. If that leaves a group of a
    draw with too few, all is done again with a bound of four times as much, so the ranks are exact.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "first")
    suffix = F.concat_ws(":", F.lit(""), key)  # the key of a draw is draw:key
    rows = df.select(suffix.cast("binary").alias("suffix"), by, "x", "y")
    n = sum(there.values())
    rows = rows.repartition(max(min(2 * spark.sparkContext.defaultParallelism, n // 500 + 1), n // 50_000))  # for the hashes, tasks of even length
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (by, "x", "y"))
    spare = 1
    while True:
        share = {c: min(1.0, spare * (m + DEVIATIONS * m**0.5 + MORE) / there[c]) if m and there.get(c) else 0.0 for c, m in wanted.items()}
        bounds = {c: int(s * 2**32) for c, s in share.items()}

        def near(batches: Iterator[pa.RecordBatch], bounds: dict = bounds) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, batch.num_rows, md5.CHUNK):
                    part = batch.slice(s, md5.CHUNK)
                    suffixes = md5.Suffixes(part.column(0))
                    bound = np.array([bounds[c] for c in part.column(1).to_pylist()], np.int64)
                    found = []
                    for d in range(draws):
                        h = suffixes.heads(f"{salt}{d}".encode()).astype(np.int64)
                        at = np.flatnonzero(h < bound)
                        found.append((np.full(len(at), d), at, h[at]))
                        if d == draws - 1 or sum(len(f[1]) for f in found) > 100_000:
                            draw, at, h = (np.concatenate(c) for c in zip(*found, strict=True))
                            yield pa.RecordBatch.from_arrays([pa.array(draw), pa.array(h), *part.take(pa.array(at)).columns], ["draw", "h", "suffix", by, "x", "y"])
                            found = []

        kept = scratch.keep(rows.mapInArrow(near, f"draw bigint, h bigint, suffix binary, {kinds}"))
        need = {c: min(m, there.get(c, 0)) for c, m in wanted.items()}
        enough = F.create_map(*[F.lit(x) for c, m in need.items() for x in (c, m)])[F.col(by)]
        full = {r[by]: r["n"] for r in kept.groupBy(by, "draw").count().where(F.col("count") >= enough).groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
        if all(full.get(c, 0) == draws for c, m in need.items() if m):
            break
        scratch.drop(kept)
        spare *= 4
    order = Window.partitionBy("draw", by).orderBy("h", "suffix")  # as many as the bound leaves
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.create_map(*[F.lit(x) for c, m in wanted.items() for x in (c, m)])[F.col(by)]).select("draw", by, "x", "y", "rank")
