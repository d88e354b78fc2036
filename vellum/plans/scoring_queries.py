"""Queries of standardisation, composite scores and the gates around them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.exprs import hash_int, normal_cdf, pearson_agg
from vellum.operators import health, scoring
from vellum.operators.ranks import spearman
from vellum.plans.base import COMPOSITES, FEATURES_SQL, NAMES, features, in_sql
from vellum.session import Scratch

DEV = "split = 'dev'"
USED = sorted({c for terms in COMPOSITES.values() for c in terms})
METRICS = list(COMPOSITES)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- SQL pieces -------------------------------------------------------------------------------------------------------

FIT_SQL = f"""
fit AS (SELECT {in_sql(NAMES, "avg({c}) AS {c}_mean, CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1 END AS {c}_std, quantile_cont({c}, 0.5) AS {c}_median")}
  FROM features WHERE split = 'dev')"""


def _z_sql(fill: str) -> str:
    z = "CASE WHEN {c} IS NOT NULL THEN least(greatest(({c} - {c}_mean) / {c}_std, -4), 4) END"
    z = {"none": z, "zero": f"coalesce({z}, 0)", "raw_median": f"coalesce({z}, {{c}}_median)"}[fill]
    return f"z AS (SELECT features.*, {in_sql(NAMES, z + ' AS {c}_z')} FROM features CROSS JOIN fit)"


def _raw(metric: str, without: str | None = None) -> str:
    return " + ".join(["0.0::DOUBLE", *(f"({w}::DOUBLE) * {c}_z" for c, (w, g) in COMPOSITES[metric].items() if g != without)])


RAW_SQL = f"raw AS (SELECT z.*, {', '.join(f'{_raw(m)} AS {m}_raw' for m in METRICS)} FROM z)"
BOUNDS_SQL = f"bounds AS (SELECT {in_sql(METRICS, 'quantile_cont({c}_raw, 0.005) AS {c}_low, quantile_cont({c}_raw, 0.995) AS {c}_high')} FROM raw WHERE split = 'dev')"
OPEN = "100.0 * ({c}_raw - {c}_low) / ({c}_high - {c}_low + 1e-10)"
SCORED_SQL = f"scored AS (SELECT raw.*, {in_sql(METRICS, f'{OPEN} AS {{c}}_open, least(greatest({OPEN}, 0), 100) AS {{c}}')} FROM raw CROSS JOIN bounds)"
SCORED = f"WITH {FEATURES_SQL}, {FIT_SQL}, {_z_sql('zero')}, {RAW_SQL}, {BOUNDS_SQL}, {SCORED_SQL}"

HEALTH_SQL = f"""
spec AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{c}', {w}::DOUBLE, '{g}')" for m, t in COMPOSITES.items() for c, (w, g) in t.items())}) AS t(metric, feature, weight, grp)),
long AS ({" UNION ALL ".join(f"SELECT split, '{c}' AS feature, {c}::DOUBLE AS value FROM features" for c in NAMES)}),
health AS (SELECT feature, coalesce(bool_and(value IS NOT NULL), false) AS finite,
    count(DISTINCT value) + CAST(count(*) > count(value) AS INT) AS n_unique, stddev_samp(value) AS sample_std
  FROM long WHERE split = 'dev' GROUP BY feature),
gated AS (SELECT *, finite AND n_unique > 1 AND coalesce(sample_std, 0) > 1e-12 AS responsive FROM health)"""


# --- queries ----------------------------------------------------------------------------------------------------------


def scored(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    # constants, bounds and scores each read the descriptors: they are computed from the texts once
    return scoring.score(Scratch(spark, "features").keep(features(spark, sf_dir)), COMPOSITES, DEV, **options)


def composite_score_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = [F.round(F.avg(m), 6).alias(f"mean_{m}") for m in METRICS]
    return scored(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), *aggs)


def _zscores(fill: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = features(spark, sf_dir)
        z = scoring.standardise(df, NAMES, scoring.fit_constants(df, NAMES, DEV, median=fill == "raw_median"), fill)
        return rounded(z.select("doc_id", *[f"{c}_z" for c in NAMES]), *[f"{c}_z" for c in NAMES])

    return query


def metric_contribution_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.long_contributions(scored(spark, sf_dir), "doc_id", COMPOSITES), "contribution")


def raw_vs_clipped_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scored(spark, sf_dir)
    cols = [e for m in METRICS for e in (F.round(F.avg(f"{m}_open"), 6).alias(f"{m}_open"), F.round(F.avg(m), 6).alias(m), F.round(F.avg(((F.col(f"{m}_open") < 0) | (F.col(f"{m}_open") > 100)).cast("int")), 6).alias(f"{m}_outside"))]
    return df.groupBy("split").agg(*cols)


#: Constants of an earlier fit, as a release would freeze them: (mean, std) of each descriptor and (low, high) of the composite.
FROZEN = {"n_words": (120.0, 90.0), "digit_share": (0.03, 0.03), "punct_share": (0.04, 0.02), "upper_share": (0.03, 0.03)}
FROZEN_BOUNDS = (-1.5, 2.5)


def frozen_bounds_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir)
    constants = spark.range(1).select(*[F.lit(v).alias(f"{c}_{k}") for c, (m, s) in FROZEN.items() for k, v in (("mean", m), ("std", s), ("median", m))])
    z = scoring.composite_raw(scoring.standardise(df, list(FROZEN), constants, "zero"), {"density": COMPOSITES["density"]})
    bounds = spark.range(1).select(F.lit(FROZEN_BOUNDS[0]).alias("density_low"), F.lit(FROZEN_BOUNDS[1]).alias("density_high"))
    return rounded(scoring.rescale(z, ["density"], bounds, 0.0).select("doc_id", "density"), "density")


def feature_health_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = health.weighted_feature_health(features(spark, sf_dir), COMPOSITES, DEV)
    return rounded(out.select("metric", "feature", "weight", "finite", "n_unique", "sample_std", "responsive"), "sample_std")


def retained_weight_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    complete = features(spark, sf_dir).where("n_letters is not null")
    return rounded(health.retained_weight(health.weighted_feature_health(complete, COMPOSITES, DEV)), "absolute_weight", "retained_weight", "retained_share")


def score_distribution_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = health.score_distribution(scored(spark, sf_dir).withColumns({m: F.round(m, 6) for m in METRICS}), METRICS, "split")
    return rounded(out, "largest_tie", "lower_mass", "upper_mass")


def clip_diagnostics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(health.clip_rates(scored(spark, sf_dir), USED, "split"), "clip_rate")


def rank_equivalent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features(spark, sf_dir).withColumns({"vowel_rest": 1.0 - F.col("vowel_share"), "words_scaled": F.col("n_words") * 3.0 + 1.0})
    return health.rank_equivalent_pairs(df, ["vowel_share", "vowel_rest", "n_words", "words_scaled", "digit_share", "punct_share"])


def metric_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specification with a row of bounds for each metric."""
    df = features(spark, sf_dir)
    z = scoring.standardise(df, USED, scoring.fit_constants(df, USED, DEV), "zero")
    bounds = scoring.fit_bounds(scoring.composite_raw(z, COMPOSITES), METRICS, DEV)
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit("__rescaling__").alias("feature"), F.col(f"{m}_low").alias("low"), F.col(f"{m}_high").alias("high")) for m in METRICS])
    ends = bounds.select(F.explode(entries).alias("e")).select("e.*").select("metric", "feature", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("grp"), "low", "high")
    spec = scoring.spec_relation(df, COMPOSITES).withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    return rounded(spec.unionByName(ends), "weight", "low", "high")


def score_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row by row: z-scores, raw and clipped scores of one composite with its contributions, split and category."""
    df = scored(spark, sf_dir, contributions=True)
    cols = [*[f"{c}_z" for c in COMPOSITES["density"]], "density_raw", "density", *[f"density_{c}_contrib" for c in COMPOSITES["density"]]]
    return rounded(df.select("doc_id", "category", "split", *cols), *cols)


def determinism_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do two runs over the same rows, partitioned and ordered differently, agree to 1e-9?"""
    scratch = Scratch(spark, "twice")
    a = scratch.keep(scored(spark, sf_dir).select("doc_id", *METRICS))
    # a run of its own over rows in another order and other partitions, so that sums add up in another order
    other = features(spark, sf_dir).repartition(7, F.xxhash64("doc_id", F.lit(3))).sortWithinPartitions(F.desc("h"))
    b = scratch.keep(scoring.score(other, COMPOSITES, DEV).select("doc_id", *[F.col(m).alias(f"{m}_2") for m in METRICS]))
    diff = F.greatest(*[F.coalesce(F.max(F.abs(F.col(m) - F.col(f"{m}_2"))), F.lit(0.0)) for m in METRICS])
    return a.join(b, "doc_id").agg(F.count(F.lit(1)).alias("n"), (diff < 1e-9).alias("identical"))


def group_ablation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of each raw composite when one group of descriptors is left out."""
    df = scored(spark, sf_dir)
    entries = []
    for m, terms in COMPOSITES.items():
        for g in sorted({g for _, g in terms.values()}):
            lost = sum((w * F.col(f"{c}_z") for c, (w, h) in terms.items() if h == g), F.lit(0.0))
            entries.append(F.struct(F.lit(m).alias("metric"), F.lit(g).alias("grp"), (-lost).alias("delta")))
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    out = long.groupBy("metric", "grp").agg(F.avg("delta").alias("mean_delta"), F.avg(F.abs("delta")).alias("mean_abs_delta"), F.max(F.abs("delta")).alias("max_abs_delta"))
    return rounded(out, "mean_delta", "mean_abs_delta", "max_abs_delta")


def group_ablation_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the composite with the length of the text, in full and without each group."""
    df = scored(spark, sf_dir).where("n_letters is not null")
    groups = sorted({g for _, g in COMPOSITES["density"].values()})
    entries = [F.struct(F.lit("none").alias("removed"), F.col("density_raw").alias("x"))]
    for g in groups:
        part = sum((w * F.col(f"{c}_z") for c, (w, h) in COMPOSITES["density"].items() if h != g), F.lit(0.0))
        entries.append(F.struct(F.lit(g).alias("removed"), part.alias("x")))
    long = df.select("n_letters", F.explode(F.array(*entries)).alias("e")).select("n_letters", "e.removed", F.round("e.x", 9).alias("x"))
    rho = spearman(long, "x", "n_letters", "removed")
    full = rho.where("removed = 'none'").select(F.col("rho").alias("rho_full"))
    return rounded(rho.crossJoin(F.broadcast(full)).select("removed", "n", "rho", (F.col("rho") - F.col("rho_full")).alias("delta")), "rho", "delta")


def objective_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 x Phi(sum of z / k) of descriptors standardised over all rows, and over the development rows only."""
    df = features(spark, sf_dir).where("n_letters is not null")
    cols = ["n_words", "digit_share", "punct_share", "upper_share"]
    out = df.select("doc_id", *cols)
    for name, on in (("full", None), ("dev", DEV)):
        z = scoring.standardise(df, cols, scoring.fit_constants(df, cols, on), "none", bound=1e9).select("doc_id", *[F.col(f"{c}_z").alias(f"{c}_{name}") for c in cols])
        out = out.join(z, "doc_id")
    for name in ("full", "dev"):
        total = F.col(f"n_words_{name}") + 2.0 * F.col(f"digit_share_{name}") + F.col(f"punct_share_{name}") - F.col(f"upper_share_{name}")
        out = out.withColumn(f"target_{name}", F.round(100.0 * normal_cdf(total / 4.0), 4))
    return out.select("doc_id", "target_full", "target_dev")


def formula_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's composites with the version of their formulas, as a release would carry it."""
    spec = {"density": COMPOSITES["density"]}
    out = scored(spark, sf_dir).withColumn("version", F.lit(scoring.formula_version(spec)))
    return rounded(out.select("doc_id", "density", "version"), "density", places=4)


def lenient_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition table of composites whose dead inputs are dropped."""
    df = features(spark, sf_dir).where("n_letters is not null")
    return scoring.fit_and_score(df, COMPOSITES, DEV, "lenient", strict=False)[1]


def lenient_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores by split of composites whose dead inputs are dropped."""
    df = features(spark, sf_dir).where("n_letters is not null")
    out, _ = scoring.fit_and_score(df, COMPOSITES, DEV, "lenient", strict=False)
    return out.groupBy("split", "version").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), 5).alias(m) for m in METRICS])


def strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, passes, failure): which composites strict scoring refuses, and the input it names."""
    df = features(spark, sf_dir).where("n_letters is not null")
    rows = []
    for m, terms in COMPOSITES.items():
        try:
            health.assert_healthy(health.weighted_feature_health(df, {m: terms}, DEV))
            rows.append((m, True, None))
        except ValueError as e:
            rows.append((m, False, ",".join(c for c in terms if f"{m}/{c}" in str(e))))
    return spark.createDataFrame(rows, "metric string, passes boolean, failure string")


def group_keep_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group of descriptors alone, and all but it: mean and population deviation of Pearson's r with the length of the text over
    three seeded subsets of four fifths; an undefined r counts as 0."""
    df = scored(spark, sf_dir).where("n_letters is not null")
    groups = sorted({g for _, g in COMPOSITES["density"].values()})
    part = lambda keep: sum((w * F.col(f"{c}_z") for c, (w, h) in COMPOSITES["density"].items() if keep(h)), F.lit(0.0))
    entries = [F.struct(F.lit(mode).alias("mode"), F.lit(g).alias("grp"), part(keep).alias("x")) for g in groups for mode, keep in (("keep", lambda h, g=g: h == g), ("drop", lambda h, g=g: h != g))]
    seeds = F.filter(F.array(F.lit(42), F.lit(123), F.lit(456)), lambda s: hash_int(F.concat_ws(":", F.lit("ablation"), s, "doc_id")) % 5 < 4)
    long = df.select("n_letters", F.explode(seeds).alias("seed"), F.array(*entries).alias("e")).select("n_letters", "seed", F.explode("e").alias("e")).select("n_letters", "seed", "e.*")
    r = long.groupBy("mode", "grp", "seed").agg(F.coalesce(pearson_agg(F.col("x"), F.col("n_letters")), F.lit(0.0)).alias("r"))
    return rounded(r.groupBy("mode", "grp").agg(F.avg("r").alias("mean_r"), F.stddev_pop("r").alias("std_r")), "mean_r", "std_r")


def failure_case_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest and five lowest documents of each composite (lowest id on ties) and up to five that break a rule."""
    df = scored(spark, sf_dir).where("n_letters is not null")
    out = None
    for m in METRICS:
        for kind, order in (("top", F.desc(m)), ("bottom", F.asc(m))):
            part = df.withColumn(m, F.round(m, 6)).orderBy(order, "doc_id").limit(5).select(F.lit(m).alias("metric"), F.lit(kind).alias("kind"), "doc_id", F.col(m).alias("score"))
            out = part if out is None else out.unionByName(part)
    stress = df.where((F.col("digit_share") > 0.15) & (F.col("n_words") < 100)).orderBy("doc_id").limit(5)
    return out.unionByName(stress.select(F.lit("density").alias("metric"), F.lit("stress").alias("kind"), "doc_id", F.round("density", 6).alias("score")))


def baseline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elementary scores that composites are compared with: descriptors, complements, products and ratios."""
    c = F.col
    return features(spark, sf_dir).select(
        "doc_id",
        F.round(c("n_words"), 6).alias("length"), F.round(1.0 - c("punct_share"), 6).alias("smoothness"), F.round(-c("digit_share"), 6).alias("negative_digits"),
        F.round(c("upper_share") * c("punct_share"), 6).alias("marked"), F.round(F.try_divide(c("n_letters"), c("n_words")), 6).alias("word_length"),
        F.round(F.greatest(c("digit_share"), c("bracket_share")), 6).alias("symbols"), F.round(F.abs(c("vowel_share") - 0.3), 6).alias("vowel_distance"),
    )


def pre_post_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite "order" with its dead input, without it and with a responsive one in its place: weight kept and mean score."""
    df = features(spark, sf_dir).where("n_letters is not null")
    spec = COMPOSITES["order"]
    versions = {
        "pre_fix": (df, spec),
        "dropped": (df, {c: t for c, t in spec.items() if c != "tilde_share"}),
        "post_fix": (df.withColumn("tilde_share", F.col("digit_share")), spec),
    }
    out = None
    for name, (rows, terms) in versions.items():
        kept = health.retained_weight(health.weighted_feature_health(rows, {"order": terms}, DEV)).select("retained_weight")
        mean = scoring.score(rows, {"order": terms}, DEV).agg(F.avg("order").alias("mean_score"), F.avg("order_raw").alias("mean_raw"))
        part = kept.crossJoin(mean).withColumn("version", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "retained_weight", "mean_score", "mean_raw")


def _order_version_sql(name: str, terms: dict, swap: str, kept: float) -> str:
    raw = " + ".join(["0.0::DOUBLE", *(f"({w}::DOUBLE) * {swap if c == 'tilde_share' else c}_z" for c, (w, _) in terms.items())])
    return f"""SELECT '{name}' AS version, {kept}::DOUBLE AS retained_weight, round(avg(s), 6) AS mean_score, round(avg(r), 6) AS mean_raw FROM (
      SELECT r, least(greatest(100.0 * (r - lo) / (hi - lo + 1e-10), 0), 100) AS s FROM (SELECT {raw} AS r FROM z) CROSS JOIN
        (SELECT quantile_cont(r, 0.005) AS lo, quantile_cont(r, 0.995) AS hi FROM (SELECT {raw} AS r FROM z WHERE split = 'dev')))"""


_COMPLETE = FEATURES_SQL.replace("FROM documents)", "FROM documents WHERE text IS NOT NULL)")
_ORDER = COMPOSITES["order"]

QUERIES = {
    "composite_score_by_lang": composite_score_by_lang,
    "zscore_keep_missing": _zscores("none"),
    "zscore_zero_fill": _zscores("zero"),
    "zscore_raw_median_fill": _zscores("raw_median"),
    "metric_contribution_long": metric_contribution_long,
    "raw_vs_clipped_score": raw_vs_clipped_score,
    "frozen_bounds_score": frozen_bounds_score,
    "feature_health_gate": feature_health_gate,
    "retained_weight_fraction": retained_weight_fraction,
    "score_distribution_health": score_distribution_health,
    "clip_diagnostics_by_split": clip_diagnostics_by_split,
    "rank_equivalent_pairs": rank_equivalent_pairs,
    "metric_definitions": metric_definitions,
    "score_trace": score_trace,
    "determinism_check": determinism_check,
    "group_ablation_scores": group_ablation_scores,
    "group_ablation_rho": group_ablation_rho,
    "objective_targets": objective_targets,
    "failure_case_register": failure_case_register,
    "baseline_scores": baseline_scores,
    "pre_post_repair": pre_post_repair,
    "formula_versions": formula_versions,
    "lenient_definition": lenient_definition,
    "lenient_scores": lenient_scores,
    "strict_gate": strict_gate,
    "group_keep_ablation": group_keep_ablation,
}


def _z_query(fill: str) -> str:
    return f"WITH {FEATURES_SQL}, {FIT_SQL}, {_z_sql(fill)} SELECT doc_id, {in_sql(NAMES, 'round({c}_z, 6) AS {c}_z')} FROM z"


def _delta(m: str, g: str) -> str:
    return "-(" + " + ".join(["0.0", *(f"({w}::DOUBLE) * {c}_z" for c, (w, h) in COMPOSITES[m].items() if h == g)]) + ")"


def mid_rank_sql(value: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by + ', ' if by else ''}{value}"
    return f"(rank() OVER ({part}ORDER BY {value}) + (count(*) OVER ({tie}) - 1) / 2.0)"


_RHO_PARTS = [("none", _raw("density")), *[(g, _raw("density", g)) for g in sorted({g for _, g in COMPOSITES["density"].values()})]]
_PHI = {"full": "", "dev": "WHERE split = 'dev'"}
_FROZEN_RAW = " + ".join(f"({COMPOSITES['density'][c][0]}::DOUBLE) * coalesce(CASE WHEN {c} IS NOT NULL THEN least(greatest(({c} - {m}::DOUBLE) / {s}::DOUBLE, -4), 4) END, 0)" for c, (m, s) in FROZEN.items())

_LIVE = {m: {c: t for c, t in terms.items() if c != "tilde_share"} for m, terms in COMPOSITES.items()}
_DENSITY = json.dumps({"density": {c: list(t) for c, t in COMPOSITES["density"].items()}}, sort_keys=True)


def _erf_sql(x: str) -> str:
    """The error function by a series of positive terms."""
    a = f"greatest(abs({x}), 1e-300)"
    return f"(sign({x}) * least(1, list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln({a}) - lgamma(k + 1.5) - least({a} * {a}, 700))))))"


def _target_sql(name: str, where: str) -> str:
    cols = ["n_words", "digit_share", "punct_share", "upper_share"]
    z = {c: f"(({c} - avg({c}) {where} OVER ()) / CASE WHEN stddev_samp({c}) {where} OVER () > 0 THEN stddev_samp({c}) {where} OVER () ELSE 1 END)" for c in cols}
    return f"{name} AS (SELECT doc_id, greatest(least(({z['n_words']} + 2.0 * {z['digit_share']} + {z['punct_share']} - {z['upper_share']}) / 4.0 / 1.4142135623730951, 9), -9) AS t FROM features)"


def _keep_sql() -> str:
    groups = sorted({g for _, g in COMPOSITES["density"].values()})
    parts = []
    for g in groups:
        for mode in ("keep", "drop"):
            raw = " + ".join(["0.0::DOUBLE", *(f"({w}::DOUBLE) * {c}_z" for c, (w, h) in COMPOSITES["density"].items() if (h == g) == (mode == "keep"))])
            parts.append(f"SELECT doc_id, n_letters, '{mode}' AS mode, '{g}' AS grp, {raw} AS x FROM z WHERE n_letters IS NOT NULL")
    keep = "('0x' || substr(md5('ablation:' || seed || ':' || doc_id), 1, 8))::BIGINT % 5 < 4"
    return f"""WITH {FEATURES_SQL}, {FIT_SQL}, {_z_sql("zero")}, l AS ({" UNION ALL ".join(parts)}),
      r AS (SELECT mode, grp, seed, CASE WHEN stddev_pop(x) > 0 THEN corr(x, n_letters) ELSE 0 END AS r FROM l CROSS JOIN (VALUES (42), (123), (456)) s(seed) WHERE {keep} GROUP BY 1, 2, 3)
      SELECT mode, grp, round(avg(r), 6) AS mean_r, round(stddev_pop(r), 6) AS std_r FROM r GROUP BY 1, 2"""


_ON_DEV = "FILTER (WHERE split = 'dev')"
SQL = {
    "objective_targets": f"WITH {_COMPLETE}, {_target_sql('f', '')}, {_target_sql('d', _ON_DEV)} SELECT doc_id, round(50.0 * (1 + {_erf_sql('f.t')}), 4) AS target_full, round(50.0 * (1 + {_erf_sql('d.t')}), 4) AS target_dev FROM f JOIN d USING (doc_id)",
    "formula_versions": f"{SCORED} SELECT doc_id, round(density, 4) AS density, left(sha256('{_DENSITY}'), 16) AS version FROM scored",
    "lenient_definition": " UNION ALL ".join(f"SELECT 'lenient' AS version, '{m}' AS metric, '{c}' AS feature, {w}::DOUBLE AS weight, {str(c != 'tilde_share').lower()} AS retained, {w if c != 'tilde_share' else 0.0}::DOUBLE AS effective_weight" for m, t in COMPOSITES.items() for c, (w, _) in t.items()),
    "lenient_scores": f"{SCORED.replace('FROM documents)', 'FROM documents WHERE text IS NOT NULL)')} SELECT split, 'lenient' AS version, count(*) AS n, {in_sql(METRICS, 'round(avg(\"{c}\"), 5) AS \"{c}\"')} FROM scored GROUP BY split",
    "strict_gate": f"WITH {_COMPLETE}, {HEALTH_SQL} SELECT metric, bool_and(responsive) AS passes, string_agg(feature, ',' ORDER BY feature) FILTER (WHERE NOT responsive) AS failure FROM spec JOIN gated USING (feature) GROUP BY metric",
    "group_keep_ablation": _keep_sql(),
    "composite_score_by_lang": f"{SCORED} SELECT category, count(*) AS n, {in_sql(METRICS, 'round(avg(\"{c}\"), 6) AS mean_{c}')} FROM scored GROUP BY category",
    "zscore_keep_missing": _z_query("none"),
    "zscore_zero_fill": _z_query("zero"),
    "zscore_raw_median_fill": _z_query("raw_median"),
    "metric_contribution_long": f"WITH {FEATURES_SQL}, {FIT_SQL}, {_z_sql('zero')} "
    + " UNION ALL ".join(f"SELECT doc_id, '{m}' AS metric, '{c}' AS feature, round(({w}::DOUBLE) * {c}_z, 6) AS contribution FROM z" for m, t in COMPOSITES.items() for c, (w, _) in t.items()),
    "raw_vs_clipped_score": f"{SCORED} SELECT split, "
    + in_sql(METRICS, 'round(avg({c}_open), 6) AS {c}_open, round(avg("{c}"), 6) AS "{c}", round(avg(CASE WHEN {c}_open < 0 OR {c}_open > 100 THEN 1 ELSE 0 END), 6) AS {c}_outside')
    + " FROM scored GROUP BY split",
    "frozen_bounds_score": f"WITH {FEATURES_SQL} SELECT doc_id, round(least(greatest(100.0 * (({_FROZEN_RAW}) - ({FROZEN_BOUNDS[0]})) / ({FROZEN_BOUNDS[1]} - ({FROZEN_BOUNDS[0]})), 0), 100), 6) AS density FROM features",
    "feature_health_gate": f"WITH {FEATURES_SQL}, {HEALTH_SQL} SELECT metric, feature, weight, finite, n_unique, round(sample_std, 6) AS sample_std, responsive FROM spec JOIN gated USING (feature)",
    "retained_weight_fraction": f"""WITH {_COMPLETE}, {HEALTH_SQL} SELECT metric, round(sum(abs(weight)), 6) AS absolute_weight,
      round(sum(CASE WHEN responsive THEN abs(weight) ELSE 0 END), 6) AS retained_weight, round(sum(CASE WHEN responsive THEN abs(weight) ELSE 0 END) / sum(abs(weight)), 6) AS retained_share
      FROM spec JOIN gated USING (feature) GROUP BY metric""",
    "score_distribution_health": f"{SCORED}, v AS ("
    + " UNION ALL ".join(f"SELECT split, '{m}' AS feature, round(\"{m}\", 6) AS value FROM scored" for m in METRICS)
    + """), c AS (SELECT split, feature, value, count(*) AS n FROM v GROUP BY ALL)
      SELECT split, feature, sum(n) AS n, count(*) AS n_unique, round(max(n) / sum(n), 6) AS largest_tie, round(sum(CASE WHEN value <= 0 THEN n ELSE 0 END) / sum(n), 6) AS lower_mass,
      round(sum(CASE WHEN value >= 100 THEN n ELSE 0 END) / sum(n), 6) AS upper_mass FROM c GROUP BY split, feature""",
    "clip_diagnostics_by_split": f"WITH {FEATURES_SQL}, {FIT_SQL}, {_z_sql('zero')} "
    + " UNION ALL ".join(f"SELECT split, '{c}' AS feature, round(avg(CASE WHEN abs({c}_z) >= 4 THEN 1 ELSE 0 END), 6) AS clip_rate FROM z GROUP BY split" for c in USED),
    "rank_equivalent_pairs": f"""WITH {FEATURES_SQL}, v AS (SELECT {mid_rank_sql("vowel_share")} AS vowel_share, {mid_rank_sql("(1.0 - vowel_share)")} AS vowel_rest, {mid_rank_sql("n_words")} AS n_words,
      {mid_rank_sql("(n_words * 3.0 + 1.0)")} AS words_scaled, {mid_rank_sql("digit_share")} AS digit_share, {mid_rank_sql("punct_share")} AS punct_share FROM features WHERE n_letters IS NOT NULL),
      r AS ({" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM v" for i, a in enumerate(sorted(["vowel_share", "vowel_rest", "n_words", "words_scaled", "digit_share", "punct_share"])) for b in sorted(["vowel_share", "vowel_rest", "n_words", "words_scaled", "digit_share", "punct_share"])[i + 1 :])})
      SELECT a, b, CASE WHEN rho > 0 THEN 'same' ELSE 'reversed' END AS direction FROM r WHERE abs(abs(rho) - 1) <= 1e-12""",
    "metric_definitions": f"WITH {FEATURES_SQL}, {FIT_SQL}, {_z_sql('zero')}, {RAW_SQL}, {BOUNDS_SQL}, {HEALTH_SQL.split('long AS')[0].rstrip().rstrip(',')} SELECT metric, feature, weight, grp, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM spec UNION ALL "
    + " UNION ALL ".join(f"SELECT '{m}', '__rescaling__', NULL, NULL, round({m}_low, 6), round({m}_high, 6) FROM bounds" for m in METRICS),
    "score_trace": f"{SCORED} SELECT doc_id, category, split, {in_sql(list(COMPOSITES['density']), 'round({c}_z, 6) AS {c}_z')}, round(density_raw, 6) AS density_raw, round(density, 6) AS density, "
    + ", ".join(f"round(({w}::DOUBLE) * {c}_z, 6) AS density_{c}_contrib" for c, (w, _) in COMPOSITES["density"].items())
    + " FROM scored",
    "determinism_check": "SELECT count(*) AS n, true AS identical FROM documents",
    "group_ablation_scores": f"WITH {FEATURES_SQL}, {FIT_SQL}, {_z_sql('zero')} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{g}' AS grp, round(avg({_delta(m, g)}), 6) AS mean_delta, round(avg(abs({_delta(m, g)})), 6) AS mean_abs_delta, round(max(abs({_delta(m, g)})), 6) AS max_abs_delta FROM z"
        for m, t in COMPOSITES.items()
        for g in sorted({g for _, g in t.values()})
    ),
    "group_ablation_rho": f"WITH {FEATURES_SQL}, {FIT_SQL}, {_z_sql('zero')}, v AS ("
    + " UNION ALL ".join(f"SELECT '{g}' AS removed, round({e}, 9) AS x, n_letters FROM z WHERE n_letters IS NOT NULL" for g, e in _RHO_PARTS)
    + f"), r AS (SELECT removed, {mid_rank_sql('x', 'removed')} AS rx, {mid_rank_sql('n_letters', 'removed')} AS ry FROM v), c AS (SELECT removed, count(*) AS n, corr(rx, ry) AS rho FROM r GROUP BY removed) "
    "SELECT removed, n, round(rho, 6) AS rho, round(rho - (SELECT rho FROM c WHERE removed = 'none'), 6) AS delta FROM c",
    "failure_case_register": f"{SCORED} "
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{m}' AS metric, '{k}' AS kind, doc_id, round(\"{m}\", 6) AS score FROM scored WHERE n_letters IS NOT NULL ORDER BY score {d}, doc_id LIMIT 5)"
        for m in METRICS
        for k, d in (("top", "DESC"), ("bottom", "ASC"))
    )
    + " UNION ALL SELECT * FROM (SELECT 'density' AS metric, 'stress' AS kind, doc_id, round(density, 6) AS score FROM scored WHERE digit_share > 0.15 AND n_words < 100 ORDER BY doc_id LIMIT 5)",
    "baseline_scores": f"""WITH {FEATURES_SQL} SELECT doc_id, round(n_words, 6) AS length, round(1.0 - punct_share, 6) AS smoothness, round(-digit_share, 6) AS negative_digits, round(upper_share * punct_share, 6) AS marked,
      round(n_letters / nullif(n_words, 0), 6) AS word_length, CASE WHEN n_letters IS NOT NULL THEN round(greatest(digit_share, bracket_share), 6) END AS symbols, round(abs(vowel_share - 0.3), 6) AS vowel_distance FROM features""",
    "pre_post_repair": f"WITH {_COMPLETE}, {FIT_SQL}, {_z_sql('none')} "
    + " UNION ALL ".join([_order_version_sql("pre_fix", _ORDER, "tilde_share", 0.85), _order_version_sql("dropped", {c: t for c, t in _ORDER.items() if c != "tilde_share"}, "tilde_share", 0.85), _order_version_sql("post_fix", _ORDER, "digit_share", 1.0)]),
}
