"""Standardisation on development rows and composite scores.

Constants are one aggregate over the fitting rows; they come back as a one-row relation that is cross joined (a broadcast of one
row), so scoring is a single projection without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.exprs import clip, total
from vellum.operators.quantiles import exact_quantiles

Spec = Mapping[str, Mapping[str, tuple[float, str]]]
CLIP = 4.0


def fit_constants(df: DataFrame, columns: list[str], fit_on: Column | str | None = None, median: bool = False) -> DataFrame:
    """One row: mean, std (sample; 0 and undefined become 1) and, if asked for, median of each column over the rows ``fit_on``."""
    rows = df if fit_on is None else df.where(fit_on)
    aggs = []
    for c in columns:
        std = F.stddev_samp(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when((std > 0) & ~F.isnan(std), std).otherwise(1.0).alias(f"{c}_std")]
    out = rows.agg(*aggs)
    if not median:
        return out
    mid = exact_quantiles(rows, columns, [0.5])
    return out.crossJoin(F.broadcast(mid.select(*[F.col(f"{c}_q")[0].alias(f"{c}_median") for c in columns])))


def standardise(df: DataFrame, columns: list[str], constants: DataFrame, fill: str = "none", bound: float = CLIP) -> DataFrame:
    """``<column>_z`` = (x - mean) / std clipped to +-bound. Missing z: ``none`` keeps NULL, ``zero`` gives 0, ``raw_median`` the median in raw units.

    The raw median is a unit error of the original pipeline that its published scores contain; it is offered for parity.
    """
    if fill not in ("none", "zero", "raw_median"):
        raise ValueError(f"unknown fill policy {fill!r}")
    out = df.crossJoin(F.broadcast(constants))
    for c in columns:
        z = clip((F.col(c) - F.col(f"{c}_mean")) / F.col(f"{c}_std"), -bound, bound)
        if fill != "none":
            z = F.coalesce(F.nanvl(z, F.lit(None).cast("double")), F.lit(0.0) if fill == "zero" else F.col(f"{c}_median"))
        out = out.withColumn(f"{c}_z", z)
    return out.drop(*[f"{c}_{k}" for c in columns for k in ("mean", "std", "median")])


def composite_raw(df: DataFrame, spec: Spec, contributions: bool = False, without: str | None = None) -> DataFrame:
    """``<metric>_raw`` = sum of weight x z; ``without`` leaves out one group; contributions as ``<metric>_<column>_contrib``."""
    for metric, terms in spec.items():
        parts = {c: w * F.col(f"{c}_z") for c, (w, g) in terms.items() if g != without}
        df = df.withColumn(f"{metric}_raw", total(list(parts.values())))
        if contributions:
            df = df.withColumns({f"{metric}_{c}_contrib": p for c, p in parts.items()})
    return df


def fit_bounds(df: DataFrame, metrics: list[str], fit_on: Column | str | None = None, low: float = 0.005, high: float = 0.995) -> DataFrame:
    rows = df if fit_on is None else df.where(fit_on)
    q = exact_quantiles(rows, [f"{m}_raw" for m in metrics], [low, high])
    return q.select(*[F.col(f"{m}_raw_q")[i].alias(f"{m}_{k}") for m in metrics for i, k in enumerate(("low", "high"))])


def rescale(df: DataFrame, metrics: list[str], bounds: DataFrame, epsilon: float = 1e-10) -> DataFrame:
    """``<metric>`` = 100 x (raw - low) / (high - low + epsilon), clipped to [0, 100]; without epsilon, equal bounds give 0."""
    out = df.crossJoin(F.broadcast(bounds))
    for m in metrics:
        width = F.col(f"{m}_high") - F.col(f"{m}_low") + epsilon
        share = F.when(width > 0, 100.0 * (F.col(f"{m}_raw") - F.col(f"{m}_low")) / width).otherwise(F.col(f"{m}_raw") * 0.0)
        out = out.withColumn(f"{m}_open", share).withColumn(m, clip(share, 0.0, 100.0))
    return out.drop(*[f"{m}_{k}" for m in metrics for k in ("low", "high")])


def score(df: DataFrame, spec: Spec, fit_on: Column | str | None = None, fill: str = "zero", epsilon: float = 1e-10, contributions: bool = False) -> DataFrame:
    """Composite scores of all rows with constants and bounds of the rows ``fit_on``: z columns, raw, open and clipped scores."""
    columns = sorted({c for terms in spec.values() for c in terms})
    z = standardise(df, columns, fit_constants(df, columns, fit_on, fill == "raw_median"), fill)
    raw = composite_raw(z, spec, contributions)
    return rescale(raw, list(spec), fit_bounds(raw, list(spec), fit_on), epsilon)


def formula_version(spec: Spec) -> str:
    """The first 16 hexadecimal digits of the SHA-256 of the specification as canonical JSON: it changes whenever a term does."""
    return hashlib.sha256(canonical(spec).encode()).hexdigest()[:16]


def canonical(spec: Spec) -> str:
    return json.dumps({m: {c: list(t) for c, t in terms.items()} for m, terms in spec.items()}, sort_keys=True)


def fit_and_score(df: DataFrame, spec: Spec, fit_on: Column | str | None = None, version: str | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(scores, definition): composites gated by the health of their inputs on the rows ``fit_on``.

    An input that is constant or not finite there is dead. With ``strict`` it is an error that names metric and feature; else its
    weight counts as zero and the others keep theirs. ``definition`` has (version, metric, feature, weight, retained,
    effective_weight); ``version`` is that of the formula unless given. A metric without a live input scores 0.
    """
    from vellum.operators.health import assert_healthy, weighted_feature_health

    health = weighted_feature_health(df, spec, fit_on)
    if strict:
        assert_healthy(health)
    rows = health.select("metric", "feature", "weight", "responsive").collect()  # a row for each term of the specification
    alive = {(r["metric"], r["feature"]) for r in rows if r["responsive"]}
    kept = {m: {c: t for c, t in terms.items() if (m, c) in alive} for m, terms in spec.items()}
    name = version or formula_version(spec)
    defined = [(name, m, c, float(w), (m, c) in alive, float(w) if (m, c) in alive else 0.0) for m, terms in spec.items() for c, (w, _) in terms.items()]
    definition = df.sparkSession.createDataFrame(defined, "version string, metric string, feature string, weight double, retained boolean, effective_weight double")
    return score(df, kept, fit_on).withColumn("version", F.lit(name)), definition


def spec_relation(df: DataFrame, spec: Spec) -> DataFrame:
    """The metric definition table (metric, feature, weight, grp): as many rows as the specification has terms."""
    rows = [(m, c, float(w), g) for m, terms in spec.items() for c, (w, g) in terms.items()]
    return df.sparkSession.createDataFrame(rows, "metric string, feature string, weight double, grp string")


def long_contributions(scored: DataFrame, key: str, spec: Spec) -> DataFrame:
    """(key, metric, feature, contribution): one row per term."""
    entries = [F.struct(F.lit(m).alias("metric"), F.lit(c).alias("feature"), (w * F.col(f"{c}_z")).alias("contribution")) for m, terms in spec.items() for c, (w, _) in terms.items()]
    return scored.select(key, F.explode(F.array(*entries)).alias("e")).select(key, "e.*")
