"""Queries of bootstraps, permutations, saturation studies and linear models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.exprs import hash_int, hash_uniform, norm
from vellum.operators import held, models, ranks, resample, stats
from vellum.plans.base import COMPOSITES, FEATURES_SQL, features
from vellum.plans.scoring_queries import DEV, FIT_SQL, SCORED, _z_sql, mid_rank_sql, rounded, scored
from vellum.operators import scoring
from vellum.session import Scratch, rows_of, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
DRAWS = 20


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _draws_sql(salt: str, source: str, column: str, draws: int = DRAWS) -> str:
    """draws(draw, cluster, mult) as cluster_draws makes them."""
    return f"""cl AS (SELECT {column} AS cluster, row_number() OVER (ORDER BY {column}) - 1 AS idx, count(*) OVER () AS k FROM (SELECT DISTINCT {column} FROM {source})),
      slots AS (SELECT d.draw, ('0x' || substr(md5('{salt}:' || d.draw || ':' || s.slot), 1, 8))::BIGINT % (SELECT max(k) FROM cl) AS idx FROM range({draws}) d(draw) CROSS JOIN (SELECT unnest(range((SELECT max(k) FROM cl))) AS slot) s),
      draws AS (SELECT draw, cluster, count(*) AS mult FROM slots JOIN cl USING (idx) GROUP BY 1, 2)"""


@query(f"WITH {FEATURES_SQL}, c0 AS (SELECT * FROM features WHERE n_words IS NOT NULL), {_draws_sql('mean', 'c0', 'cluster')}, s AS (SELECT cluster, sum(n_words) AS s, count(*) AS n FROM c0 GROUP BY 1) SELECT draw, round(sum(mult * s) / sum(mult * n), 6) AS mean FROM draws JOIN s USING (cluster) GROUP BY draw")
def cluster_bootstrap_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.cluster_bootstrap_mean(features(spark, d), "n_words", "cluster", DRAWS), "mean")


def _boot(x: str, y: str, out: str = "rho", places: int = 6) -> str:
    return f"""WITH {FEATURES_SQL}, c0 AS (SELECT * FROM features WHERE n_words IS NOT NULL), {_draws_sql("rho", "c0", "cluster")},
      e AS (SELECT draw, {x} AS x, {y} AS y FROM draws JOIN c0 USING (cluster) CROSS JOIN range(30) r(i) WHERE i < mult),
      r AS (SELECT draw, {mid_rank_sql("x", "draw")} AS rx, {mid_rank_sql("y", "draw")} AS ry FROM e)
      SELECT draw, round(corr(rx, ry), {places}) AS {out} FROM r GROUP BY draw"""


@query(_boot("digit_share", "punct_share"))
def cluster_bootstrap_rho(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.cluster_bootstrap_spearman(features(spark, d), "digit_share", "punct_share", "cluster", DRAWS), "rho")


@query(f"SELECT count(*) AS n_draws, round(quantile_cont(rho, 0.025), 5) AS low, round(quantile_cont(rho, 0.975), 5) AS high FROM ({_boot('digit_share', 'punct_share', places=12)})")
def cluster_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    draws = resample.cluster_bootstrap_spearman(features(spark, d), "digit_share", "punct_share", "cluster", DRAWS)
    return rounded(resample.percentile_interval(draws, "rho"), "low", "high", places=5)


@query(f"SELECT a.draw, round(a.rho - b.rho, 6) AS delta FROM ({_boot('digit_share', 'n_words')}) a JOIN ({_boot('punct_share', 'n_words')}) b USING (draw)")
def paired_delta_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two correlations on the same resamples."""
    df = features(spark, d)
    a = rounded(resample.cluster_bootstrap_spearman(df, "digit_share", "n_words", "cluster", DRAWS), "rho")
    b = rounded(resample.cluster_bootstrap_spearman(df, "punct_share", "n_words", "cluster", DRAWS), "rho").withColumnRenamed("rho", "other")
    return a.join(b, "draw").select("draw", F.round(F.col("rho") - F.col("other"), 6).alias("delta"))


def _poisson_sql(u: str) -> str:
    cumulated, term, out = 0.36787944117144233, 0.36787944117144233, []
    for k in range(1, 14):
        out.append(f"({u} >= {cumulated!r})::INT")
        term /= k
        cumulated += term
    return "(" + " + ".join(out) + ")"


_U = "('0x' || substr(md5('iid:' || draw || ':' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"WITH {FEATURES_SQL}, l AS (SELECT draw, n_words AS v, category = 'en' AS g, {_poisson_sql(_U)} AS w FROM features CROSS JOIN range({DRAWS}) r(draw) WHERE n_words IS NOT NULL) SELECT draw, round(sum(w * v) FILTER (WHERE g) / sum(w) FILTER (WHERE g) - sum(w * v) FILTER (WHERE NOT g) / sum(w) FILTER (WHERE NOT g), 5) AS difference FROM l GROUP BY draw")
def iid_bootstrap_mean_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.iid_bootstrap_mean_difference(features(spark, d), "doc_id", "n_words", F.col("category") == "en", DRAWS), "difference", places=5)


_POINTS = f"""WITH {FEATURES_SQL}, l AS (SELECT draw, digit_share AS x, n_words AS y, {_poisson_sql(_U)} AS w FROM features CROSS JOIN range({DRAWS}) r(draw) WHERE n_words IS NOT NULL),
  e AS (SELECT draw, x, y FROM l CROSS JOIN range(14) r(i) WHERE i < w), k AS (SELECT draw, x, y, {mid_rank_sql("x", "draw")} AS rx, {mid_rank_sql("y", "draw")} AS ry FROM e),
  p AS (SELECT draw, x, y, sum(w) AS w FROM l WHERE w > 0 GROUP BY 1, 2, 3),
  c AS (SELECT a.draw, sum(sign(a.x - b.x) * sign(a.y - b.y) * a.w * b.w) / 2 AS s FROM p a JOIN p b ON a.draw = b.draw GROUP BY 1),
  n AS (SELECT draw, sum(w) AS n FROM p GROUP BY 1), tx AS (SELECT draw, sum(t * (t - 1) / 2) AS tx FROM (SELECT draw, x, sum(w) AS t FROM p GROUP BY 1, 2) GROUP BY 1),
  ty AS (SELECT draw, sum(t * (t - 1) / 2) AS ty FROM (SELECT draw, y, sum(w) AS t FROM p GROUP BY 1, 2) GROUP BY 1)"""


@query(f"{_POINTS} SELECT 'rho' AS statistic, draw::INT AS draw, round(corr(rx, ry), 6) AS value FROM k GROUP BY draw UNION ALL SELECT 'r', draw::INT, round(corr(x, y), 6) FROM k GROUP BY draw UNION ALL SELECT 'tau', draw::INT, round(s / (sqrt(n * (n - 1) / 2 - tx) * sqrt(n * (n - 1) / 2 - ty)), 6) FROM c JOIN n USING (draw) JOIN tx USING (draw) JOIN ty USING (draw)")
def iid_bootstrap_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Rank, Pearson and Kendall correlation of rows drawn with replacement."""
    return rounded(resample.iid_bootstrap_correlations(features(spark, d), "doc_id", "digit_share", "n_words", DRAWS), "value")


@query()
def iid_bootstrap_correlations_full(spark: SparkSession, d: str) -> DataFrame:
    """(statistic, n_draws, low, high): the 95 % interval of each over 1000 draws."""
    draws = resample.iid_bootstrap_correlations(features(spark, d), "doc_id", "digit_share", "n_words", 1000)
    return resample.percentile_interval(draws, "value", "statistic")


_TERMS = list(COMPOSITES["density"].items())
_FACTOR = "(0.9::DOUBLE + 0.2::DOUBLE * (('0x' || substr(md5('weights:' || draw || ':{c}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE))"
_PERT = ", ".join(f"({w}::DOUBLE) * {_FACTOR.format(c=c)} AS w_{c}" for c, (w, _) in _TERMS)
_NORM = " + ".join(f"abs(w_{c})" for c, _ in _TERMS)


@query(f"WITH {FEATURES_SQL}, {FIT_SQL}, {_z_sql('zero')}, w AS (SELECT draw, {_PERT} FROM range({DRAWS}) r(draw)), l AS (SELECT draw, round(({' + '.join(f'w_{c} * {c}_z' for c, _ in _TERMS)}) / ({_NORM}), 9) AS x, round({' + '.join(f'({w}::DOUBLE) * {c}_z' for c, (w, _) in _TERMS)}, 9) AS y FROM z CROSS JOIN w WHERE n_letters IS NOT NULL), r AS (SELECT draw, {mid_rank_sql('x', 'draw')} AS rx, {mid_rank_sql('y', 'draw')} AS ry FROM l) SELECT draw, round(corr(rx, ry), 6) AS rho FROM r GROUP BY draw")
def weight_perturbation(spark: SparkSession, d: str) -> DataFrame:
    """Rank agreement of the composite with itself under weights drawn from 0.9 to 1.1 of theirs and renormalised."""
    return _perturbed(features(spark, d), DRAWS)


def _perturbed(df: DataFrame, n_draws: int) -> DataFrame:
    cols = [c for c, _ in _TERMS]
    z = scoring.standardise(df, cols, scoring.fit_constants(df, cols, DEV), "zero").where("n_letters is not null")
    draws = df.sparkSession.range(n_draws).toDF("draw")
    for c, (w, _) in _TERMS:
        draws = draws.withColumn(f"w_{c}", w * (0.9 + 0.2 * hash_uniform(F.concat_ws(":", F.lit("weights"), "draw", F.lit(c)))))
    size = sum((F.abs(f"w_{c}") for c in cols), F.lit(0.0))
    y = F.round(sum((w * F.col(f"{c}_z") for c, (w, _) in _TERMS), F.lit(0.0)), 9)
    points = Scratch(df.sparkSession, "perturbed").keep(z.select(y.alias("y"), *[f"{c}_z" for c in cols]).groupBy("y", *[f"{c}_z" for c in cols]).agg(F.count(F.lit(1)).alias("n")))
    if rows_of(points) <= held.HELD_POINTS:
        told = draws.withColumn("size", size).orderBy("draw").toArrow()  # a row per draw
        weights = np.stack([told[f"w_{c}"].to_numpy() for c in cols], axis=1)
        rho = held.rank_of_forms(points.withColumn("g", F.lit(0)), [f"{c}_z" for c in cols], weights, told["size"].to_numpy(), 9)
    else:
        x = sum((F.col(f"w_{c}") * F.col(f"{c}_z") for c in cols), F.lit(0.0)) / size
        long = points.crossJoin(F.broadcast(draws)).select("draw", "n", F.round(x, 9).alias("x"), "y")
        rho = ranks.spearman(long, "x", "y", "draw", weight="n")
    return rounded(rho.select("draw", "rho"), "rho")


_LEVELS = "v AS (SELECT c_custkey AS k, c_nationkey AS block, c_acctbal AS level FROM customer)"


@query(f"WITH {_LEVELS}, a AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY ('0x' || substr(md5('perm:' || k), 1, 8))::BIGINT, k) AS t, row_number() OVER (PARTITION BY block ORDER BY k) AS p FROM v) SELECT x.k, y.level AS permuted FROM a x JOIN a y ON x.block = y.block AND x.t = y.p")
def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """Levels dealt anew within each block."""
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("block"), F.col("c_acctbal").alias("level"))
    return resample.permuted_levels(v, "k", "block", "level", "perm:").select("k", "permuted")


_SUB = "u AS (SELECT DISTINCT user_id % 12 AS rater FROM events), s AS (SELECT draw, rater FROM (SELECT draw, rater, row_number() OVER (PARTITION BY draw ORDER BY ('0x' || substr(md5('raters:' || draw || ':' || rater), 1, 8))::BIGINT, rater) AS k FROM u CROSS JOIN range(10) r(draw)) WHERE k <= 4)"


@query(f"WITH {_SUB}, e AS (SELECT user_id % 12 AS rater, event_id % 40 AS item, value FROM events), f AS (SELECT item, avg(value) AS y FROM e GROUP BY 1), p AS (SELECT draw, item, avg(value) AS x FROM e JOIN s USING (rater) GROUP BY 1, 2), j AS (SELECT draw, round(x, 9) AS x, round(y, 9) AS y FROM p JOIN f USING (item)), r AS (SELECT draw, {mid_rank_sql('x', 'draw')} AS rx, {mid_rank_sql('y', 'draw')} AS ry, abs(x - y) AS d FROM j) SELECT draw, round(corr(rx, ry), 6) AS rho, round(avg(d), 6) AS mad FROM r GROUP BY draw")
def rater_saturation(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the mean of 4 raters with that of all, over draws without replacement."""
    e = table(spark, d, "events").select((F.col("user_id") % 12).alias("rater"), (F.col("event_id") % 40).alias("item"), "value")
    cells = e.groupBy("rater", "item").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))  # rows are read once, draws use cells
    full = cells.groupBy("item").agg((F.sum("s") / F.sum("n")).alias("y"))
    part = cells.join(resample.subset_draws(cells, "rater", 4, 10, "raters"), "rater").groupBy("draw", "item").agg((F.sum("s") / F.sum("n")).alias("x"))
    j = part.join(full, "item").select("draw", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))
    mad = j.groupBy("draw").agg(F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 6).alias("mad"))
    return rounded(ranks.spearman(j, "x", "y", "draw").select("draw", "rho"), "rho").join(mad, "draw")


@query("WITH g AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1), b AS (SELECT user_id FROM g WHERE m < 45 OR s < 5) SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_raters, round(avg(value), 6) AS mean FROM events WHERE user_id NOT IN (SELECT user_id FROM b) GROUP BY 1")
def rater_filter_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Raters who answer too low or without spread are dropped before aggregation."""
    e = table(spark, d, "events")
    bad = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).where("m < 45 or s < 5").select("user_id")
    return e.join(bad, "user_id", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_raters"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT 'rows' AS metric, count(*)::DOUBLE AS value FROM events UNION ALL SELECT 'raters', count(DISTINCT user_id) FROM events UNION ALL SELECT 'lowest', min(value) FROM events UNION ALL SELECT 'highest', max(value) FROM events UNION ALL SELECT 'missing', count(*) - count(value) FROM events UNION ALL SELECT 'type_' || event_type, count(*) FROM events GROUP BY event_type")
def rating_quality_counters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    one = e.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("raters"), F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count_if(F.col("value").isNull()).alias("missing"))
    names = ["rows", "raters", "lowest", "highest", "missing"]
    long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("e")).select("e.*")
    return long.unionByName(e.groupBy(F.concat(F.lit("type_"), "event_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value")))


@query("WITH v AS (SELECT p_brand AS g, p_size::DOUBLE AS x, p_retailprice AS y FROM part), s AS (SELECT g, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM v GROUP BY g) SELECT g, round((sxy - sx * sy / n) / (sxx - sx * sx / n + 1), 6) AS slope, round(sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) * sx / n, 4) AS intercept FROM s")
def calibration_slopes(spark: SparkSession, d: str) -> DataFrame:
    """One-input ridge per brand in closed form."""
    slope, intercept = models.calibration_slope("x", "y")
    v = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return v.groupBy("g").agg(F.round(slope, 6).alias("slope"), F.round(intercept, 4).alias("intercept"))


_INPUTS = ["n_words", "digit_share", "punct_share", "upper_share"]


@query()
def ridge_probe(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of the robust ridge with the strength picked on validation rows; tests hold it against a dense solution."""
    model, _ = models.select_ridge(features(spark, d), _INPUTS, "vowel_share", "split")
    return models.coefficients(features(spark, d), model)


@query()
def ridge_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation, MAE and R squared of the probe on test rows."""
    df = features(spark, d)
    model, _ = models.select_ridge(df, _INPUTS, "vowel_share", "split")
    test = models.predict(df.where("split = 'test' and n_words is not null"), model)
    m = stats.error_metrics(F.col("vowel_share"), F.col("prediction"))
    return ranks.spearman(test, "prediction", "vowel_share").crossJoin(test.agg(*[v.alias(k) for k, v in m.items()]))


@query()
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    return models.pca_variance(table(spark, d, "embeddings"), "embedding", 64)


_COV = "c AS (SELECT i, j, covar_samp(embedding[i]::DOUBLE, embedding[j]::DOUBLE) AS v FROM embeddings CROSS JOIN range(1, 65) a(i) CROSS JOIN range(1, 65) b(j) GROUP BY 1, 2)"


@query(f"WITH {_COV} SELECT 64 AS n_components, round(sum(v) FILTER (WHERE i = j), 6) AS total_variance, round(sum(v * v), 6) AS squared FROM c")
def pca_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Number, sum and sum of squares of the components' variances: trace and norm of the covariance."""
    out = models.pca_variance(table(spark, d, "embeddings"), "embedding", 64)
    return out.agg(F.count(F.lit(1)).cast("int").alias("n_components"), F.round(F.sum("variance"), 6).alias("total_variance"), F.round(F.sum(F.col("variance") ** 2), 6).alias("squared"))


@query()
def pca_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Every vector on the first eight components."""
    out = models.pca_projection(table(spark, d, "embeddings"), "embedding", 64, 8)
    return rounded(out.select("vec_id", *[f"pc{i}" for i in range(1, 9)]), *[f"pc{i}" for i in range(1, 9)])


@query(f"WITH {_COV} SELECT 64 AS n_components, 0 AS n_correlated, round(sum(v) FILTER (WHERE i = j), 5) AS total_variance FROM c")
def pca_uncorrelated(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates on all components: no two correlate, and their variances add up to those of the dimensions."""
    names = [f"pc{i}" for i in range(1, 65)]
    out = models.pca_projection(table(spark, d, "embeddings"), "embedding", 64, 64)
    pairs = [F.abs(F.covar_samp(a, b)) > 1e-9 for i, a in enumerate(names) for b in names[i + 1 : i + 4]]
    return out.agg(
        F.lit(64).alias("n_components"), sum((p.cast("int") for p in pairs), F.lit(0)).alias("n_correlated"), F.round(sum((F.var_samp(c) for c in names), F.lit(0.0)), 5).alias("total_variance")
    )


@query("SELECT unnest(['n_words', 'digit_share', 'punct_share', 'upper_share']) AS feature, true AS stationary")
def ridge_optimality(spark: SparkSession, d: str) -> DataFrame:
    """Is the probe's loss flat in each coefficient? Judged on the residuals of all rows it was fitted to, not on its Gram matrix."""
    df = features(spark, d).where("n_words is not null")
    model, _ = models.select_ridge(df, _INPUTS, "vowel_share", "split")
    fitted = models.predict(df.where("split in ('dev', 'validation')"), model)
    error = F.col("vowel_share") - F.col("prediction")
    scaled = models._scaled(model.columns, model.centre, model.scale)
    sums = fitted.agg(*[F.sum(error * x).alias(c) for c, x in zip(model.columns, scaled, strict=True)])
    flat = [F.struct(F.lit(c).alias("feature"), (F.abs(F.col(c) - model.alpha * b) < 1e-6).alias("stationary")) for c, b in zip(model.columns, model.beta[1:], strict=True)]
    return sums.select(F.explode(F.array(*flat)).alias("e")).select("e.*")


@query("WITH c AS (SELECT list(m ORDER BY i) AS centre FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings CROSS JOIN range(1, 65) r(i) GROUP BY i)) SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - centre[i]) * (embedding[i]::DOUBLE - centre[i])))), 5) AS distance FROM embeddings CROSS JOIN c")
def embedding_centred_norm(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each vector from the mean vector."""
    df = table(spark, d, "embeddings")
    centre = df.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = centre.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))  # one number per dimension
    moved = F.zip_with("embedding", "centre", lambda x, m: x.cast("double") - m)
    return df.crossJoin(F.broadcast(centre)).select("vec_id", F.round(norm(moved), 5).alias("distance"))


@query("WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), p AS (SELECT label AS prompt, list(m ORDER BY i) AS v FROM (SELECT label, i, avg(e[i]) AS m FROM n CROSS JOIN range(1, 65) r(i) WHERE label < 2 GROUP BY 1, 2) GROUP BY 1), s AS (SELECT vec_id, max(list_cosine_similarity(e, v)) FILTER (WHERE prompt = 1) AS a, max(list_cosine_similarity(e, v)) FILTER (WHERE prompt = 0) AS b FROM n CROSS JOIN p GROUP BY 1) SELECT vec_id, round(6 / (1 + exp(-5 * (a - b))) + 1, 5) AS rating FROM s")
def zero_shot_rating(spark: SparkSession, d: str) -> DataFrame:
    """Cosine to a positive and a negative prompt vector (two label means), squashed to a rating of 1 to 7."""
    from vellum.functions.exprs import cosine, logistic_scale

    df = table(spark, d, "embeddings")
    cells = df.where("label < 2").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vector = lambda k, name: cells.where(f"label = {k}").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(name))
    both = vector(1, "pos").crossJoin(vector(0, "neg"))
    e = F.transform("embedding", lambda x: x.cast("double"))
    return df.crossJoin(F.broadcast(both)).select("vec_id", F.round(logistic_scale(cosine(e, F.col("pos")), cosine(e, F.col("neg"))), 5).alias("rating"))


@query("SELECT p_partkey, round(4 + 1.2 * (z - m) / s, 5) AS rating FROM (SELECT p_partkey, z, avg(z) OVER () AS m, stddev_pop(z) OVER () AS s FROM (SELECT p_partkey, 0.7 * (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () - 0.3 * (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS z FROM part))".replace("round(4 + 1.2 * (z - m) / s, 5)", "round(least(greatest(4 + 1.2 * (z - m) / s, 1), 7), 5)"))
def rating_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """Ratings of mean 4 and deviation 1.2 from weighted z-scores (population deviation), clipped to [1, 7]."""
    from vellum.functions.exprs import clip

    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").cast("double").alias("b"))
    fit = F.broadcast(p.agg(F.avg("a").alias("ma"), F.stddev_pop("a").alias("sa"), F.avg("b").alias("mb"), F.stddev_pop("b").alias("sb")))
    z = p.crossJoin(fit).select("p_partkey", (0.7 * (F.col("a") - F.col("ma")) / F.col("sa") - 0.3 * (F.col("b") - F.col("mb")) / F.col("sb")).alias("z"))
    scale = F.broadcast(z.agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")))
    return z.crossJoin(scale).select("p_partkey", F.round(clip(4 + 1.2 * (F.col("z") - F.col("m")) / F.col("s"), 1.0, 7.0), 5).alias("rating"))


@query("WITH v AS (SELECT doc_id, ('0x' || substr(md5('a:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, ('0x' || substr(md5('b:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS v FROM documents) SELECT doc_id, round(sqrt(-2 * ln(1 - u)) * cos(6.283185307179586 * v), 6) AS noise FROM v")
def hash_normal_noise(spark: SparkSession, d: str) -> DataFrame:
    """Standard normal noise from two hashed uniforms (Box and Muller), for noisy targets that can be made again."""
    u = hash_uniform(F.concat(F.lit("a:"), F.col("doc_id").cast("string")))
    v = hash_uniform(F.concat(F.lit("b:"), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", F.round(F.sqrt(-2 * F.ln(1 - u)) * F.cos(6.283185307179586 * v), 6).alias("noise"))


_SETS = {"size": ["n_letters", "n_words"], "symbols": ["digit_share", "punct_share", "bracket_share"], "case": ["upper_share"], "all": ["n_letters", "n_words", "digit_share", "punct_share", "bracket_share", "upper_share"]}


@query()
def experiment_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every feature set and ridge strength from two Gram matrices; tests hold it against single fits."""
    return models.experiment_grid(features(spark, d).where("n_words is not null"), _SETS, "vowel_share", "split")


@query()
def tree_probe(spark: SparkSession, d: str) -> DataFrame:
    """A forest and boosted trees on development rows, judged on test rows. Trees differ between versions, so there is no SQL."""
    df = features(spark, d).where("n_words is not null")
    out = None
    for kind in ("forest", "boosted"):
        test = models.fit_trees(df.where("split = 'dev'"), _INPUTS, "vowel_share", kind, trees=10).transform(df.where("split = 'test'").fillna(0.0, subset=_INPUTS))
        m = stats.error_metrics(F.col("vowel_share"), F.col("prediction"))
        part = test.agg(*[v.alias(k) for k, v in m.items()]).withColumn("model", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


_SAT = "('0x' || substr(md5('images:' || draw || ':' || doc_id), 1, 8))::BIGINT"


@query(f"WITH {FEATURES_SQL}, k AS (SELECT draw, digit_share AS x, punct_share AS y, row_number() OVER (PARTITION BY draw, category ORDER BY {_SAT}, draw || ':' || doc_id) AS r FROM features CROSS JOIN range(10) t(draw) WHERE n_words IS NOT NULL), s AS (SELECT * FROM k WHERE r <= 15), v AS (SELECT draw, {mid_rank_sql('x', 'draw')} AS rx, {mid_rank_sql('y', 'draw')} AS ry FROM s) SELECT draw, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM v GROUP BY draw")
def image_saturation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation in stratified subsets of 15 documents per category, over draws without replacement."""
    from vellum.operators.order import hashed_rank

    df = features(spark, d).where("n_words is not null").select("doc_id", "category", "digit_share", "punct_share")
    long = df.crossJoin(F.broadcast(spark.range(10).toDF("draw"))).withColumn("key", F.concat_ws(":", "draw", "doc_id"))
    picked = hashed_rank(long, "key", "images:", "draw", "category").where("rank <= 15")
    return rounded(ranks.spearman(picked, "digit_share", "punct_share", "draw"), "rho")


_CAL = "('0x' || substr(md5('labels:' || draw || ':' || p_partkey), 1, 8))::BIGINT"


@query(f"WITH k AS (SELECT draw, p_size::DOUBLE AS x, p_retailprice AS y, row_number() OVER (PARTITION BY draw ORDER BY {_CAL}, draw || ':' || p_partkey) <= 40 AS fit FROM part CROSS JOIN range(10) t(draw)), s AS (SELECT draw, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM k WHERE fit GROUP BY draw), b AS (SELECT draw, (sxy - sx * sy / n) / (sxx - sx * sx / n + 1) AS slope, sx / n AS mx, sy / n AS my FROM s) SELECT draw, round(slope, 6) AS slope, round(avg(abs(y - (my + slope * (x - mx)))), 4) AS mae FROM k JOIN b USING (draw) WHERE NOT fit GROUP BY draw, slope")
def calibration_efficiency(spark: SparkSession, d: str) -> DataFrame:
    """A one-input ridge on 40 labels, judged on all other rows, over draws."""
    from vellum.operators.order import hashed_rank

    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    long = p.crossJoin(F.broadcast(spark.range(10).toDF("draw"))).withColumn("key", F.concat_ws(":", "draw", "p_partkey"))
    dealt = hashed_rank(long, "key", "labels:", "draw")
    slope, intercept = models.calibration_slope("x", "y")
    fit = dealt.where("rank <= 40").groupBy("draw").agg(slope.alias("slope"), intercept.alias("intercept"))
    rest = dealt.where("rank > 40").join(F.broadcast(fit), "draw")  # a row per draw
    return rest.groupBy("draw", F.round("slope", 6).alias("slope")).agg(F.round(F.avg(F.abs(F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))), 4).alias("mae"))


@query(f"{SCORED} SELECT count(*) AS n, true AS agree FROM scored")
def recomputation_audit(spark: SparkSession, d: str) -> DataFrame:
    """Composites summed from long contributions against the wide projection: they agree to 1e-10."""
    df = scored(spark, d)
    parts = scoring.long_contributions(df, "doc_id", COMPOSITES).groupBy("doc_id").pivot("metric", list(COMPOSITES)).agg(F.sum("contribution"))
    wide = df.select("doc_id", *[f"{m}_raw" for m in COMPOSITES])
    diff = F.greatest(*[F.coalesce(F.max(F.abs(F.col(m) - F.col(f"{m}_raw"))), F.lit(0.0)) for m in COMPOSITES])
    return wide.join(parts, "doc_id").agg(F.count(F.lit(1)).alias("n"), (diff < 1e-10).alias("agree"))


@query()
def association_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of each descriptor with the length of the text and its cluster-bootstrap interval (2000 draws)."""
    df = features(spark, d).where("n_words is not null")
    out = None
    for c in ("digit_share", "punct_share", "upper_share"):
        draws = resample.cluster_bootstrap_spearman(df, c, "n_letters", "cluster", 2000)
        part = ranks.spearman(df, c, "n_letters").crossJoin(F.broadcast(resample.percentile_interval(draws, "rho"))).withColumn("feature", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


#: Subset sizes of D51 (documents) and D52 (labels), each spread evenly over the categories.
IMAGE_SIZES, LABEL_SIZES = (20, 40, 60, 80, 100), (5, 10, 20, 40, 60)
#: Draws of the survey: B1, D28, D50 and D51 take 1000, B2 and B3 2000, D52 100 for each number of labels.
IID_DRAWS, CLUSTER_DRAWS, LABEL_DRAWS = 1000, 2000, 100


@query()
def cluster_bootstrap_ci_full(spark: SparkSession, d: str) -> DataFrame:
    """``cluster_bootstrap_ci`` with the survey's draws."""
    draws = resample.cluster_bootstrap_spearman(features(spark, d), "digit_share", "punct_share", "cluster", CLUSTER_DRAWS)
    return rounded(resample.percentile_interval(draws, "rho"), "low", "high", places=5)


@query()
def paired_delta_bootstrap_full(spark: SparkSession, d: str) -> DataFrame:
    """``paired_delta_bootstrap`` with the survey's draws: both correlations on the same resamples."""
    df = features(spark, d)
    a = resample.cluster_bootstrap_spearman(df, "digit_share", "n_words", "cluster", CLUSTER_DRAWS)
    b = resample.cluster_bootstrap_spearman(df, "punct_share", "n_words", "cluster", CLUSTER_DRAWS).withColumnRenamed("rho", "other")
    return a.join(b, "draw").select("draw", F.round(F.col("rho") - F.col("other"), 6).alias("delta"))


@query()
def iid_bootstrap_mean_diff_full(spark: SparkSession, d: str) -> DataFrame:
    """``iid_bootstrap_mean_diff`` with the survey's draws."""
    return rounded(resample.iid_bootstrap_mean_difference(features(spark, d), "doc_id", "n_words", F.col("category") == "en", IID_DRAWS), "difference", places=5)


@query()
def weight_perturbation_full(spark: SparkSession, d: str) -> DataFrame:
    """``weight_perturbation`` with the survey's draws."""
    return _perturbed(features(spark, d), IID_DRAWS)


@query()
def rater_saturation_full(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the mean of m raters with that of all, for every m, over the survey's draws without replacement."""
    e = table(spark, d, "events").select((F.col("user_id") % 12).alias("rater"), (F.col("event_id") % 40).alias("item"), "value")
    return rater_grid(e, IID_DRAWS)


def rater_grid(e: DataFrame, n_draws: int) -> DataFrame:
    """(m, n_draws, rho, low, high, mad, overlap, sufficient) of ratings (rater, item, value), medians over the draws of m raters.

    ``overlap`` is the share of the tenth of the items rated lowest and of that rated highest which the draw has as well;
    ``sufficient`` is the least m with a median rho of .95 and a lower bound of .90.
    """
    cells = e.groupBy("rater", "item").agg(F.sum("value").alias("s"), F.count("value").alias("n"))  # rows are read once, draws use cells
    full = cells.groupBy("item").agg(F.round(F.try_divide(F.sum("s"), F.sum("n")), 9).alias("y")).where("y is not null")
    raters = cells.select("rater").where("rater is not null").distinct().count()
    # subsets of a draw are nested: m raters are the first m in its order
    order = resample.subset_draws(cells, "rater", raters, n_draws, "raters")
    h = hash_int(F.concat_ws(":", F.lit("raters"), "draw", F.col("rater").cast("string")))
    order = order.withColumn("k", F.row_number().over(Window.partitionBy("draw").orderBy(h, "rater")))
    upto = Window.partitionBy("draw", "item").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    grid = order.select("draw", "rater", F.col("k").alias("m")).crossJoin(F.broadcast(full))  # draws x raters x items, cells that are missing too
    part = grid.join(F.broadcast(cells), ["rater", "item"], "left").withColumn("x", F.round(F.try_divide(F.sum("s").over(upto), F.sum("n").over(upto)), 9))
    j = part.where("x is not null").select("m", "draw", "item", "x", "y")
    of_draw = Window.partitionBy("m", "draw")
    place = lambda c, up: F.row_number().over(of_draw.orderBy(F.col(c) if up else F.col(c).desc(), F.col("item") if up else F.col("item").desc()))
    least = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(of_draw) / 10))
    ends = lambda c: (place(c, True) <= least) | (place(c, False) <= least)
    told = j.withColumns({"in_x": ends("x"), "in_y": ends("y")})
    draws = told.groupBy("m", "draw").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mad"), (F.count_if(F.col("in_x") & F.col("in_y")) / F.count_if("in_y")).alias("overlap"))
    rho = ranks.spearman(j, "x", "y", "m", "draw").select("m", "draw", "rho")
    q = F.percentile("rho", [0.025, 0.5, 0.975])
    out = rho.join(draws, ["m", "draw"]).groupBy("m").agg(F.count(F.lit(1)).alias("n_draws"), F.round(q[1], 6).alias("rho"), F.round(q[0], 6).alias("low"), F.round(q[2], 6).alias("high"), F.round(F.median("mad"), 6).alias("mad"), F.round(F.median("overlap"), 6).alias("overlap"))
    enough = F.min(F.when((F.col("rho") >= 0.95) & (F.col("low") >= 0.9), F.col("m"))).over(Window.partitionBy())  # a row for each m
    return out.withColumn("sufficient", enough)


@query()
def image_saturation_full(spark: SparkSession, d: str) -> DataFrame:
    """(n, n_draws, full_rho, rho, bias, std, low, high): correlation in stratified subsets of n documents over the survey's draws."""
    df = features(spark, d).where("n_words is not null").select(F.col("doc_id").alias("key"), "category", F.col("digit_share").alias("x"), F.col("punct_share").alias("y"))
    return image_grid(df, IMAGE_SIZES, IID_DRAWS)


def _dealt(df: DataFrame, sizes: tuple, n_draws: int, salt: str) -> DataFrame:
    """(size, draw, x, y, picked): in each draw the first ``size`` / categories rows of each category in a seeded order; sizes are nested.

    The first categories give one more where that doesn't divide. Categories of fewer rows give all of theirs; a row without a category counts as one more.
    """
    from vellum.operators.order import hashed_rank

    df = df.withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("")))
    names = sorted(r["category"] for r in df.select("category").distinct().collect())
    k, at = len(names), F.array_position(F.array(*[F.lit(c) for c in names]), F.col("category"))
    long = df.crossJoin(F.broadcast(df.sparkSession.range(n_draws).toDF("draw"))).withColumn("key", F.concat_ws(":", "draw", "key"))
    rank = hashed_rank(long, "key", salt, "draw", "category")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), (n // k + (at <= n % k).cast("int")).alias("of_each")) for n in sizes]))
    return rank.select("draw", "x", "y", "rank", each.alias("s")).select("s.size", "draw", "x", "y", (F.col("rank") <= F.col("s.of_each")).alias("picked"))


def image_grid(df: DataFrame, sizes: tuple, n_draws: int) -> DataFrame:
    df = Scratch(df.sparkSession, "images").keep(df.select("key", F.coalesce(F.col("category").cast("string"), F.lit("")).alias("category"), "x", "y"))
    held_by = {r["category"]: r["count"] for r in df.groupBy("category").count().collect()}
    names = sorted(held_by) or [""]
    of_each = lambda n: [n // len(names) + (i < n % len(names)) for i in range(len(names))]  # noqa: E731  as _dealt has them
    wanted = {c: max(col) for c, col in zip(names, zip(*map(of_each, sizes), strict=True), strict=True)}
    first = resample.first_of_draws(df, "key", "category", wanted, held_by, n_draws, "images:")
    quotas = {n: dict(zip(names, of_each(n), strict=True)) for n in sizes}

    def of_sizes(t: pa.Table) -> pa.Table:
        category, rank, x, y = t["category"].to_pylist(), t["rank"].to_numpy(), t["x"], t["y"]
        both = np.asarray(pc.and_(x.is_valid(), y.is_valid()).to_numpy(), bool)
        x, y, found = x.to_numpy(), y.to_numpy(), []
        for size, quota in quotas.items():
            at = both & (rank <= np.array([quota[c] for c in category]))
            n = float(at.sum())
            if n:
                rx, ry = held.centred_ranks(x[at], np.ones(int(n))), held.centred_ranks(y[at], np.ones(int(n)))
                found.append((size, held.correlation(float(rx @ rx), float(ry @ ry), float(rx @ ry), n)))
        return pa.table({"size": pa.array([f[0] for f in found], pa.int32()), "rho": pa.array([f[1] for f in found], pa.float64())})

    # a draw has the rows of the largest size at most
    rho = first.select("draw", "category", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "rank").groupBy("draw").applyInArrow(of_sizes, "size int, rho double")
    full = ranks.spearman(df, "x", "y").select(F.col("rho").alias("full_rho"))
    q = F.percentile("rho", [0.025, 0.5, 0.975])
    out = rho.groupBy(F.col("size").alias("n")).agg(F.count("rho").alias("n_draws"), q[1].alias("rho"), F.stddev_pop("rho").alias("std"), q[0].alias("low"), q[2].alias("high"))
    return rounded(out.crossJoin(F.broadcast(full)).withColumn("bias", F.col("rho") - F.col("full_rho")), "full_rho", "rho", "bias", "std", "low", "high")


@query()
def calibration_efficiency_full(spark: SparkSession, d: str) -> DataFrame:
    """(k, n_draws, frozen_rho, rho, std, gain): a one-input ridge on k labels, ranked against all other rows, over the survey's draws."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("category"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return label_grid(p.withColumn("category", F.substring("category", 1, 7)), LABEL_SIZES, LABEL_DRAWS)


def label_grid(df: DataFrame, sizes: tuple, n_draws: int) -> DataFrame:
    dealt = _dealt(df, sizes, n_draws, "labels:")
    slope, _ = models.calibration_slope("x", "y")
    fit = dealt.where("picked").groupBy("size", "draw").agg(slope.alias("slope"))
    # predictions are linear in x: their ranks on the other rows are those of x, or turned round
    rho = ranks.spearman(dealt.where("not picked"), "x", "y", "size", "draw").join(fit, ["size", "draw"]).withColumn("rho", F.when(F.col("slope") != 0, F.signum("slope") * F.col("rho")))
    full = ranks.spearman(df, "x", "y").select(F.col("rho").alias("frozen_rho"))
    out = rho.groupBy(F.col("size").alias("k")).agg(F.count("rho").alias("n_draws"), F.median("rho").alias("rho"), F.stddev_pop("rho").alias("std"))
    return rounded(out.crossJoin(F.broadcast(full)).withColumn("gain", F.col("rho") - F.col("frozen_rho")), "frozen_rho", "rho", "std", "gain")


_CONTROL = ["n_words", "punct_share", "upper_share", "bracket_share"]


@query()
def negative_control(spark: SparkSession, d: str) -> DataFrame:
    """Per split: the probe's rank correlation with its target, and that of 100 probes fitted to permuted targets."""
    return models.permutation_control(features(spark, d).where("n_words is not null"), "doc_id", _CONTROL, "digit_share", "split", ("dev", "validation"), 10.0, 100)


@query()
def structure_null(spark: SparkSession, d: str) -> DataFrame:
    """The same with targets that stay within their category: structure is kept, only its order is lost."""
    return models.permutation_control(features(spark, d).where("n_words is not null"), "doc_id", _CONTROL, "digit_share", "split", ("dev", "validation"), 10.0, 100, block="category")
