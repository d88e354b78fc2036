"""Gates on inputs and scores: dead features, lost weight, rank-equivalent candidates, boundary collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.ranks import rank_correlations
from vellum.operators.scoring import Spec, spec_relation

LEAST_STD = 1e-12


def melt(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, feature, value) as doubles."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")).select(*keys, "e.*")


def feature_health(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """(by, feature, finite, n_unique, sample_std, responsive). NULL and NaN are one distinct value each and not finite."""
    values = melt(df, columns, *by).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    solid = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    n = F.sum(F.when(solid, F.col("n")))
    mean = F.sum(F.when(solid, F.col("n") * F.col("value"))) / n
    sums = values.groupBy(*by, "feature").agg(F.bool_and(solid).alias("finite"), F.count(F.lit(1)).alias("n_unique"), n.alias("_n"), mean.alias("_mean"))
    # the second pass over distinct values avoids the cancellation of sums of squares
    keys = [*by, "feature"]
    spread = values.join(sums.select(*keys, "_mean"), keys).groupBy(*keys).agg(F.sum(F.when(solid, F.col("n") * (F.col("value") - F.col("_mean")) ** 2)).alias("_ss"))
    out = sums.join(spread, keys).withColumn("sample_std", F.sqrt(F.try_divide(F.col("_ss"), F.col("_n") - 1)))
    good = F.col("finite") & (F.col("n_unique") > 1) & (F.coalesce("sample_std", F.lit(0.0)) > LEAST_STD)
    return out.select(*keys, "finite", "n_unique", "sample_std", good.alias("responsive"))


def weighted_feature_health(df: DataFrame, spec: Spec, fit_on: Column | str | None = None) -> DataFrame:
    """(metric, feature, weight, finite, n_unique, sample_std, responsive) of every weighted input on the rows ``fit_on``.

    A column that the frame lacks, or no row to fit on, is an error.
    """
    columns = sorted({c for terms in spec.values() for c in terms})
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the frame: {missing}")
    rows = df if fit_on is None else df.where(fit_on)
    return spec_relation(df, spec).drop("grp").join(feature_health(rows, columns), "feature", "left")


def assert_healthy(health: DataFrame) -> None:
    """Raise naming every metric/feature that isn't responsive. The relation has as many rows as the specification."""
    dead = [f"{r['metric']}/{r['feature']}" for r in health.where(~F.coalesce("responsive", F.lit(False))).orderBy("metric", "feature").collect()]
    if dead or health.isEmpty():
        raise ValueError("inputs that do not respond: " + (", ".join(dead) or "no rows to judge them by"))


def retained_weight(health: DataFrame) -> DataFrame:
    """(metric, absolute_weight, retained_weight, retained_share): what is left when dead inputs are dropped."""
    w = F.abs("weight")
    kept = F.sum(F.when(F.coalesce("responsive", F.lit(False)), w).otherwise(0.0))
    return health.groupBy("metric").agg(F.sum(w).alias("absolute_weight"), kept.alias("retained_weight"), (kept / F.sum(w)).alias("retained_share"))


def rank_equivalent_pairs(df: DataFrame, columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(a, b, direction): pairs of columns with one ranking, the same or reversed."""
    rho = rank_correlations(df, columns)
    direction = F.when(F.col("rho") > 0, "same").otherwise("reversed")
    return rho.where((F.col("a") < F.col("b")) & (F.abs(F.abs("rho") - 1.0) <= max(tolerance, 1e-12))).select("a", "b", direction.alias("direction"))


def score_distribution(df: DataFrame, scores: list[str], *by: str) -> DataFrame:
    """(by, feature, n, n_unique, largest_tie, lower_mass, upper_mass): ties and mass at the bounds 0 and 100."""
    values = melt(df, scores, *by).where("value is not null").groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    return values.groupBy(*by, "feature").agg(
        n.alias("n"),
        F.count(F.lit(1)).alias("n_unique"),
        (F.max("n") / n).alias("largest_tie"),
        (F.sum(F.when(F.col("value") <= 0, F.col("n")).otherwise(0)) / n).alias("lower_mass"),
        (F.sum(F.when(F.col("value") >= 100, F.col("n")).otherwise(0)) / n).alias("upper_mass"),
    )


def clip_rates(df: DataFrame, columns: list[str], *by: str, bound: float = 4.0) -> DataFrame:
    """(by, feature, clip_rate): share of rows with a z-score at the bound."""
    return melt(df, [f"{c}_z" for c in columns], *by).groupBy(*by, F.regexp_replace("feature", "_z$", "").alias("feature")).agg(F.avg((F.abs("value") >= bound).cast("int")).alias("clip_rate"))
