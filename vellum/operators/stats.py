"""Descriptive and test statistics from sums: one aggregate, then arithmetic on a row per group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.distributions import chi2_upper, f_quantile, f_upper, normal_quantile
from vellum.operators.quantiles import exact_quantiles
from vellum.operators.ranks import mid_ranks


def p_column(kind: str):
    """A vectorised tail probability: ``f``(x, d1, d2) or ``chi2``(x, d). It runs on one row per test."""

    @F.pandas_udf("double")
    def f(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else f_upper(a, b, c) for a, b, c in zip(x, d1, d2, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def chi2(x: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else chi2_upper(a, b) for a, b in zip(x, d, strict=True)], dtype="float64")

    return {"f": f, "chi2": chi2}[kind]


def cohens_d(df: DataFrame, value: str, group: str, least: int = 10) -> DataFrame:
    """(a, b, n_a, n_b, d) for all pairs of groups with ``least`` rows: mean difference over the pooled sample deviation."""
    moments = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where(F.col("n") >= least)
    a = moments.select(F.col(group).alias("a"), F.col("n").alias("n_a"), F.col("m").alias("m_a"), F.col("v").alias("v_a"))
    b = moments.select(F.col(group).alias("b"), F.col("n").alias("n_b"), F.col("m").alias("m_b"), F.col("v").alias("v_b"))
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", "n_a", "n_b", F.try_divide(F.col("m_a") - F.col("m_b"), pooled).alias("d"))


def error_metrics(truth: Column, guess: Column) -> dict[str, Column]:
    """Aggregates mae, rmse and r2 (NULL for a constant truth) over the rows with both values."""
    both = truth.isNotNull() & guess.isNotNull()
    t, e = F.when(both, truth), F.when(both, truth - guess)
    n = F.count(e)
    ss = F.sum(t * t) - F.sum(t) * F.sum(t) / n
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "r2": F.when(ss > 1e-12 * F.sum(t * t), 1.0 - F.try_divide(F.sum(e * e), ss))}


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row (f, df_between, df_within, p, eta_squared) of the one-way analysis of variance."""
    cells = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    sums = cells.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = cells.crossJoin(F.broadcast(sums.select("grand"))).agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"))
    row = sums.crossJoin(F.broadcast(between)).withColumns({"df_between": F.col("k") - 1, "df_within": F.col("n") - F.col("k")})
    f = F.try_divide(F.col("between") / F.col("df_between"), F.col("within") / F.col("df_within"))
    row = row.withColumns({"f": f, "eta_squared": F.try_divide(F.col("between"), F.col("between") + F.col("within"))})
    return row.select("f", "df_between", "df_within", p_column("f")("f", F.col("df_between").cast("double"), F.col("df_within").cast("double")).alias("p"), "eta_squared")


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Levene's test around group medians: an analysis of variance of absolute deviations."""
    centre = exact_quantiles(df, [value], [0.5], group).select(group, F.col(f"{value}_q")[0].alias("_centre"))
    return anova(df.join(centre, group).withColumn("_dev", F.abs(F.col(value) - F.col("_centre"))), "_dev", group)


def kruskal_wallis(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row (h, df, p) with the correction for ties."""
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranks = mid_ranks(rows, value)
    sums = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("_m")).join(ranks.select(value, "rank"), value).groupBy(group).agg(F.sum("_m").alias("n"), F.sum(F.col("_m") * F.col("rank")).alias("r"))
    h = sums.agg(F.count(F.lit(1)).alias("k"), F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    ties = ranks.agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("t"))
    row = h.crossJoin(F.broadcast(ties))
    raw = 12.0 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3.0 * (F.col("n") + 1)
    row = row.withColumns({"h": F.try_divide(raw, 1.0 - F.col("t") / (F.col("n") ** 3 - F.col("n"))), "df": F.col("k") - 1})
    return row.select("h", "df", p_column("chi2")("h", F.col("df").cast("double")).alias("p"))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """One row (chi2, df, p) over blocks that have every treatment once, with the correction for ties."""
    k = df.select(treatment).distinct().count()
    complete = df.where(F.col(value).isNotNull()).groupBy(block).agg(F.count(F.lit(1)).alias("_k"), F.countDistinct(treatment).alias("_d")).where(f"_k = {k} and _d = {k}").select(block)
    rows = df.join(complete, block)
    ranks = mid_ranks(rows, value, block)
    sums = rows.join(ranks.select(block, value, "rank"), [block, value]).groupBy(treatment).agg(F.sum("rank").alias("r"))
    ties = ranks.agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("t"), F.countDistinct(block).alias("b"))
    row = sums.agg(F.sum(F.col("r") ** 2).alias("s")).crossJoin(F.broadcast(ties))
    b = F.col("b")
    raw = 12.0 / (b * k * (k + 1)) * F.col("s") - 3.0 * b * (k + 1)
    row = row.withColumn("chi2", F.try_divide(raw, 1.0 - F.col("t") / (b * (k**3 - k))))
    return row.select("chi2", F.lit(k - 1).cast("bigint").alias("df"), p_column("chi2")("chi2", F.lit(float(k - 1))).alias("p"))


def icc_agreement(df: DataFrame, subject: str, rater: str, value: str, confidence: float = 0.95) -> DataFrame:
    """One row of two-way agreement over the complete cells: icc1 (single) and icck (mean of raters), f, df1, df2, p and the interval of icc1.

    Mean squares come from sums per subject and per rater. Subjects that lack a rater are left out.
    """
    k = df.select(rater).distinct().count()
    cells = df.where(F.col(value).isNotNull()).groupBy(subject, rater).agg(F.avg(value).alias("x"))
    full = cells.groupBy(subject).agg(F.count(F.lit(1)).alias("_k"), F.avg("x").alias("_row")).where(f"_k = {k}").drop("_k")
    rows = cells.join(full, subject)
    grand = rows.agg(F.avg("x").alias("_grand"), F.countDistinct(subject).alias("n"))
    by_rater = rows.groupBy(rater).agg(F.avg("x").alias("_col"))
    resid = rows.join(F.broadcast(by_rater), rater).crossJoin(F.broadcast(grand))  # a row per rater and one row
    g = F.col("_grand")
    sums = resid.groupBy("n").agg(
        F.sum((F.col("_row") - g) ** 2).alias("ssr"), F.sum((F.col("_col") - g) ** 2).alias("ssc"), F.sum((F.col("x") - F.col("_row") - F.col("_col") + g) ** 2).alias("sse")
    )
    n = F.col("n")
    ms = sums.withColumns({"msr": F.col("ssr") / (n - 1), "msc": F.col("ssc") / (k - 1), "mse": F.col("sse") / ((n - 1) * (k - 1))})
    single = F.try_divide(F.col("msr") - F.col("mse"), F.col("msr") + (k - 1) * F.col("mse") + k * (F.col("msc") - F.col("mse")) / n)
    mean = F.try_divide(F.col("msr") - F.col("mse"), F.col("msr") + (F.col("msc") - F.col("mse")) / n)
    out = ms.withColumns({"icc1": single, "icck": mean, "f": F.try_divide("msr", "mse")})
    schema = "n bigint, k bigint, icc1 double, icck double, f double, df1 bigint, df2 bigint, p double, low double, high double"

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                df1, df2 = r.n - 1, (r.n - 1) * (k - 1)
                a = k * r.icc1 / (r.n * (1 - r.icc1))
                b = 1 + k * r.icc1 * (r.n - 1) / (r.n * (1 - r.icc1))
                v = (a * r.msc + b * r.mse) ** 2 / ((a * r.msc) ** 2 / (k - 1) + (b * r.mse) ** 2 / df2)
                q = (1 + confidence) / 2
                f1, f2 = f_quantile(q, df1, v), f_quantile(q, v, df1)
                rest = k * r.msc + (k * r.n - k - r.n) * r.mse
                rows.append((r.n, k, r.icc1, r.icck, r.f, df1, df2, f_upper(r.f, df1, df2), r.n * (r.msr - f1 * r.mse) / (f1 * rest + r.n * r.msr), r.n * (f2 * r.msr - r.mse) / (rest + r.n * f2 * r.msr)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return out.select("n", "icc1", "icck", "f", "msr", "msc", "mse").mapInPandas(finish, schema)


def shapiro_wilk(values) -> tuple[float, float]:
    """W and its p-value by Royston's approximation, for 4 to 5000 values."""
    import numpy as np

    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = n**-0.5, float(m @ m)
    a = m / mm**0.5
    # polynomials of Royston (1995): fixed values
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
    if n > 5:
        prev = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
        a = m / phi**0.5
        a[-2], a[1] = prev, -prev
    else:
        a = m / ((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)) ** 0.5
    a[-1], a[0] = last, -last
    w = float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum())
    from math import erfc, log, sqrt

    if n <= 11:
        g, mu = -2.273 + 0.459 * n, np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n)
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), np.exp(mu)
        z = (-log(max(g - log(1 - w), 1e-300)) - mean) / sd
    else:
        ln = log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), np.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
        z = (log(1 - w) - mean) / sd
    return w, 0.5 * erfc(z / sqrt(2))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float, *by: str) -> DataFrame:
    """(by, bin, n) of equal-width bins 0 .. bins - 1; the top edge belongs to the last bin, values outside to none."""
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(value).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantile_bins(df: DataFrame, value: str, bins: int, mean_of: str) -> DataFrame:
    """(bin, n, mean_x, mean_y) of quantile bins, right-closed, edges that coincide dropped."""
    rows = df.where(F.col(value).isNotNull())
    edges = exact_quantiles(rows, [value], [i / bins for i in range(bins + 1)]).select(F.array_distinct(f"{value}_q").alias("edges"))
    at = F.greatest(F.size(F.filter("edges", lambda e: e < F.col(value))) - 1, F.lit(0))
    return rows.crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_x"), F.avg(mean_of).alias("mean_y"))


# --- decision rules ---------------------------------------------------------------------------------------------------


def association_status(rho: Column, low: Column, q: Column) -> Column:
    """strong: rho >= .60, interval above 0 and q < .05; partial: the same from .30 to .60; a strong rho with a bad q is a failure."""
    sure = (low > 0) & (q < 0.05)
    return F.when((rho >= 0.60) & sure, "strong").when((rho >= 0.30) & (rho < 0.60) & sure, "partial").otherwise("failure")


def selectivity_status(margin: Column) -> Column:
    return F.when(margin >= 0.15, "strong").when(margin > 0, "partial").otherwise("failure")


def family_status(n_good: Column, n: Column) -> Column:
    return F.when((n_good == n) & (n > 0), "strong").when(n_good > 0, "partial").otherwise("failure")


def monotone_status(up: Column, down: Column, n: Column) -> Column:
    return F.when(F.try_divide(up, n) >= 0.75, "strong").when(up > down, "partial").otherwise("failure")


def overall_status(association: Column, margin: Column, family: Column) -> Column:
    """Strong only if all three are; partial needs a positive margin and a family status of exactly partial."""
    strong = (association == "strong") & (selectivity_status(margin) == "strong") & (family == "strong")
    partial = association.isin("strong", "partial") & (margin > 0) & (family == "partial")
    return F.when(strong, "strong").when(partial, "partial").otherwise("failure")
