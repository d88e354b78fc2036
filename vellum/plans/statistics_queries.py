"""Queries of correlations, decision rules, test statistics and reliability."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions.exprs import entropy_from_counts, hash_int, pearson_agg
from vellum.operators import resample, ranks, stats
from vellum.plans.base import COMPOSITES, FEATURES_SQL, features
from vellum.plans.scoring_queries import SCORED, mid_rank_sql, rounded, scored
from vellum.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
PROXIES = list(COMPOSITES)
TARGETS = ["n_letters", "digit_share", "vowel_share"]
MATRIX = ["n_words", "digit_share", "punct_share", "upper_share"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def complete(spark: SparkSession, d: str) -> DataFrame:
    """Composites rounded, so that both engines see the same ties, with targets, split and cluster."""
    return scored(spark, d).where("n_letters is not null").select("doc_id", "split", "cluster", "category", *[F.round(f"{m}_raw", 6).alias(m) for m in PROXIES], *TARGETS)


COMPLETE = f"{SCORED}, complete AS (SELECT doc_id, split, cluster, category, {', '.join(f'round({m}_raw, 6) AS p_{m}' for m in PROXIES)}, {', '.join(TARGETS)} FROM scored WHERE n_letters IS NOT NULL)"


def _pairs_sql(where: str = "", by: str = "") -> str:
    """(by, proxy, target, n, rho) of all proxies and targets."""
    k = f"{by}, " if by else ""
    parts = []
    for m in PROXIES:
        for t in TARGETS:
            inner = f"SELECT {k}{mid_rank_sql(f'p_{m}', by)} AS x, {mid_rank_sql(t, by)} AS y FROM complete {where}"
            parts.append(f"SELECT {k}'{m}' AS proxy, '{t}' AS target, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS rho FROM ({inner}) {('GROUP BY ' + by) if by else ''}")
    return " UNION ALL ".join(parts)


def association_frame(df: DataFrame, *by: str) -> DataFrame:
    """(by, proxy, target, n, rho): all proxies against all targets from one ranking of the long frame."""
    cols = [*PROXIES, *TARGETS]
    rho = ranks.rank_correlations(df, cols, *by)
    n = df.dropna(subset=cols).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    rows = rho.where(F.col("a").isin(PROXIES) & F.col("b").isin(TARGETS))
    rows = rows.join(n, list(by)) if by else rows.crossJoin(F.broadcast(n))
    return rows.select(*by, F.col("a").alias("proxy"), F.col("b").alias("target"), "n", "rho")


@query(f"{COMPLETE} SELECT proxy, target, n, round(rho, 6) AS rho FROM ({_pairs_sql()})")
def association_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(association_frame(complete(spark, d)), "rho")


@query(f"{COMPLETE}, a AS ({_pairs_sql()}) SELECT proxy, round(max(abs(rho)) FILTER (WHERE target = 'n_letters') - max(abs(rho)) FILTER (WHERE target <> 'n_letters'), 6) AS margin, arg_max(target, (abs(rho), target)) FILTER (WHERE target <> 'n_letters') AS rival FROM a GROUP BY proxy")
def selectivity_margin(spark: SparkSession, d: str) -> DataFrame:
    """Absolute correlation with the nominal target less the largest with any other, the last name on ties."""
    a, size, nominal = association_frame(complete(spark, d)), F.abs("rho"), F.col("target") == "n_letters"
    margin = F.max(F.when(nominal, size)) - F.max(F.when(~nominal, size))
    rival = F.max(F.when(~nominal, F.struct(size.alias("s"), "target")))["target"]
    return a.groupBy("proxy").agg(F.round(margin, 6).alias("margin"), rival.alias("rival"))


@query(f"{COMPLETE} SELECT cluster, proxy, target, n, round(rho, 6) AS rho FROM ({_pairs_sql(by='cluster')}) WHERE n >= 10")
def per_cluster_rho(spark: SparkSession, d: str) -> DataFrame:
    return rounded(association_frame(complete(spark, d), "cluster").where("n >= 10"), "rho")


_FAMILY = "CASE WHEN rho >= 0.3 THEN 1 ELSE 0 END"
_STATUS = "CASE WHEN rho >= 0.6 AND q < 0.05 THEN 'strong' WHEN rho >= 0.3 AND q < 0.05 THEN 'partial' ELSE 'failure' END"


@query(f"""{COMPLETE}, a AS ({_pairs_sql()}), f AS ({_pairs_sql("WHERE category IN ('en', 'de', 'fr', 'es', 'zh')", "category")}),
 m AS (SELECT proxy, abs(max(rho) FILTER (WHERE target = 'n_letters')) - max(abs(rho)) FILTER (WHERE target <> 'n_letters') AS margin, max(rho) FILTER (WHERE target = 'n_letters') AS rho FROM a GROUP BY proxy),
 g AS (SELECT proxy, sum({_FAMILY}) AS good, count(*) AS n FROM f WHERE target = 'n_letters' AND n >= 10 GROUP BY proxy),
 s AS (SELECT proxy, rho, margin, CASE WHEN rho >= 0.6 THEN 'strong' WHEN rho >= 0.3 THEN 'partial' ELSE 'failure' END AS association,
  CASE WHEN margin >= 0.15 THEN 'strong' WHEN margin > 0 THEN 'partial' ELSE 'failure' END AS selectivity, CASE WHEN good = n THEN 'strong' WHEN good > 0 THEN 'partial' ELSE 'failure' END AS family FROM m JOIN g USING (proxy))
 SELECT proxy, round(rho, 6) AS rho, round(margin, 6) AS margin, association, selectivity, family, CASE WHEN association = 'strong' AND selectivity = 'strong' AND family = 'strong' THEN 'strong'
  WHEN association <> 'failure' AND margin > 0 AND family = 'partial' THEN 'partial' ELSE 'failure' END AS overall FROM s""")
def decision_status_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Association, selectivity, family and overall status of each proxy; the interval and q of the ladder are taken as passed here."""
    df = complete(spark, d)
    a = association_frame(df)
    nominal, size = F.col("target") == "n_letters", F.abs("rho")
    m = a.groupBy("proxy").agg(F.max(F.when(nominal, F.col("rho"))).alias("rho"), (F.max(F.when(nominal, size)) - F.max(F.when(~nominal, size))).alias("margin"))
    f = association_frame(df.where(F.col("category").isin("en", "de", "fr", "es", "zh")), "category").where(nominal & (F.col("n") >= 10))
    g = f.groupBy("proxy").agg(F.count_if(F.col("rho") >= 0.3).alias("good"), F.count(F.lit(1)).alias("k"))
    s = m.join(g, "proxy").withColumns({"association": stats.association_status(F.col("rho"), F.lit(1.0), F.lit(0.0)), "selectivity": stats.selectivity_status(F.col("margin")), "family": stats.family_status(F.col("good"), F.col("k"))})
    s = s.withColumn("overall", stats.overall_status(F.col("association"), F.col("margin"), F.col("family")))
    return rounded(s.select("proxy", "rho", "margin", "association", "selectivity", "family", "overall"), "rho", "margin")


_MATRIX_SQL = " UNION ALL ".join(f"SELECT split, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho FROM r GROUP BY split" for a in MATRIX for b in MATRIX)
_RANKED = f"r AS (SELECT split, {', '.join(f'{mid_rank_sql(c, chr(115) + chr(112) + chr(108) + chr(105) + chr(116))} AS {c}' for c in MATRIX)} FROM features WHERE n_words IS NOT NULL)"


@query(f"WITH {FEATURES_SQL}, {_RANKED} SELECT split, a, b, round(rho, 6) AS rho FROM ({_MATRIX_SQL})")
def spearman_matrix_by_split(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranks.rank_correlations(features(spark, d), MATRIX, "split"), "rho")


@query(f"WITH {FEATURES_SQL}, {_RANKED} SELECT split, round(max(abs(rho)), 6) AS largest FROM ({_MATRIX_SQL}) WHERE a <> b GROUP BY split")
def max_offdiagonal(spark: SparkSession, d: str) -> DataFrame:
    rho = ranks.rank_correlations(features(spark, d), MATRIX, "split").where("a != b")
    return rho.groupBy("split").agg(F.round(F.max(F.abs("rho")), 6).alias("largest"))


@query(f"WITH {FEATURES_SQL} SELECT category, count(*) AS n, round(CASE WHEN stddev_pop(n_words) > 0 AND stddev_pop(n_letters) > 0 THEN corr(n_words, n_letters) END, 6) AS r_letters, CAST(NULL AS DOUBLE) AS r_constant FROM features WHERE n_words IS NOT NULL GROUP BY category HAVING count(*) > 1")
def pearson_safe(spark: SparkSession, d: str) -> DataFrame:
    """Product-moment correlation that is NULL, not an error, for a constant input."""
    df = features(spark, d).where("n_words is not null").groupBy("category")
    out = df.agg(F.count(F.lit(1)).alias("n"), pearson_agg(F.col("n_words"), F.col("n_letters")).alias("r_letters"), pearson_agg(F.col("n_words"), F.col("tilde_share")).alias("r_constant"))
    return rounded(out.where("n > 1"), "r_letters", "r_constant")


_NATION = "SELECT c_nationkey, round(avg(c_acctbal), 2) AS x, count(*) AS y FROM customer GROUP BY 1"


@query(f"WITH v AS ({_NATION}), p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x <> b.x AS dx, a.y <> b.y AS dy FROM v a JOIN v b ON a.c_nationkey < b.c_nationkey) SELECT (SELECT count(*) FROM v) AS n, round(sum(s) / sqrt(count(*) FILTER (WHERE dx)::DOUBLE * count(*) FILTER (WHERE dy)), 6) AS tau FROM p")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 2).alias("x"), F.count(F.lit(1)).alias("y"))
    return rounded(ranks.kendall_tau_b(v, "x", "y"), "tau")


#: p-values of a family of tests, taken from the data: a portable hash of each metric and target.
_P_SQL = "(('0x' || substr(md5(metric || '/' || target), 1, 8))::BIGINT / 4294967296.0) * (('0x' || substr(md5(metric || '/' || target), 1, 8))::BIGINT / 4294967296.0)"


@query(f"WITH t AS (SELECT DISTINCT metric, target, {_P_SQL} AS p FROM per_seed_external_metrics WHERE metric IS NOT NULL AND target IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM t) SELECT metric, target, round(p, 8) AS p, round(least(min(p * m / k) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 1), 8) AS q FROM r")
def bh_fdr_adjust(spark: SparkSession, d: str) -> DataFrame:
    tests = table(spark, d, "per_seed_external_metrics").select("metric", "target").where("metric is not null and target is not null").distinct()
    u = hash_int(F.concat_ws("/", "metric", "target")) / 4294967296.0
    return rounded(ranks.benjamini_hochberg(tests.withColumn("p", u * u), "p"), "p", "q", places=8)


_NOMINAL = "replace(lower(trim(generator)), '-', '_')"
_GOOD = "generator IS NOT NULL AND trim(generator) <> '' AND abs(rho) <= 1"


@query(f"WITH v AS (SELECT {_NOMINAL} AS g, rho FROM per_seed_external_metrics WHERE {_GOOD}), m AS (SELECT g, count(*) AS n, avg(rho) AS m, var_samp(rho) AS v FROM v GROUP BY g HAVING count(*) >= 10) SELECT a.g AS a, b.g AS b, a.n AS n_a, b.n AS n_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 6) AS d FROM m a JOIN m b ON a.g < b.g")
def structural_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.cohens_d(_correlations(spark, d), "rho", "generator"), "d")


def _correlations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "per_seed_external_metrics").where(_GOOD).select(F.expr(_NOMINAL).alias("generator"), "seed", "metric", "target", "rho")


_CELLS = f"v AS (SELECT {_NOMINAL} AS g, rho AS x FROM per_seed_external_metrics WHERE {_GOOD})"
_ANOVA = "c AS (SELECT g, count(*) AS n, avg(x) AS m, var_pop(x) AS s FROM {v} GROUP BY g), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum(n * s) AS w FROM c), b AS (SELECT sum(c.n * (m - gm) * (m - gm)) AS b FROM c CROSS JOIN t) SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS f, k - 1 AS df_between, (n - k)::BIGINT AS df_within, round(b / (b + w), 6) AS eta_squared FROM t CROSS JOIN b"


@query(f"WITH {_CELLS}, {_ANOVA.format(v='v')}")
def anova_oneway(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(stats.anova(_correlations(spark, d), "rho", "generator").drop("p"), "f", places=5), "eta_squared")


@query(f"WITH {_CELLS}, u AS (SELECT g, quantile_cont(x, 0.5) AS mid FROM v GROUP BY g), w0 AS (SELECT g, abs(x - mid) AS x FROM v JOIN u USING (g)), {_ANOVA.format(v='w0')}")
def levene_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(rounded(stats.levene(_correlations(spark, d), "rho", "generator").drop("p"), "f", places=5), "eta_squared")


@query(f"WITH {_CELLS}, r AS (SELECT g, {mid_rank_sql('x')} AS r FROM v), s AS (SELECT g, count(*) AS n, sum(r) AS r FROM r GROUP BY g), t AS (SELECT sum(m * m * m - m)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS m FROM v GROUP BY x)), a AS (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(r * r / n) AS s FROM s) SELECT round((12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 5) AS h, k - 1 AS df FROM a CROSS JOIN t")
def kruskal_wallis(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.kruskal_wallis(_correlations(spark, d), "rho", "generator").drop("p"), "h", places=5)


_CUBE = "cube AS (SELECT c_nationkey AS subject, c_mktsegment AS rater, round(avg(c_acctbal), 0) AS x FROM customer GROUP BY 1, 2), whole AS (SELECT subject FROM cube GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT rater) FROM cube)), full_cube AS (SELECT * FROM cube JOIN whole USING (subject))"


def _cube(spark: SparkSession, d: str) -> DataFrame:
    """Nations as subjects, market segments as raters, the mean balance as rating."""
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("subject"), F.col("c_mktsegment").alias("rater")).agg(F.round(F.avg("c_acctbal"), 0).alias("x"))


@query(f"WITH {_CUBE}, r AS (SELECT subject, rater, {mid_rank_sql('x', 'subject')} AS r FROM full_cube), s AS (SELECT rater, sum(r) AS r FROM r GROUP BY 1), t AS (SELECT sum(m * m * m - m)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS m FROM full_cube GROUP BY subject, x)), a AS (SELECT sum(r * r) AS s, count(*)::DOUBLE AS k FROM s), n AS (SELECT count(*)::DOUBLE AS b FROM whole) SELECT round((12.0 / (b * k * (k + 1)) * s - 3 * b * (k + 1)) / (1 - t / (b * (k * k * k - k))), 5) AS chi2, (k - 1)::BIGINT AS df FROM a CROSS JOIN t CROSS JOIN n")
def friedman_test(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.friedman(_cube(spark, d), "subject", "rater", "x").drop("p"), "chi2", places=5)


@query(f"WITH {_CUBE}, g AS (SELECT avg(x) AS g, count(DISTINCT subject)::DOUBLE AS n, count(DISTINCT rater)::DOUBLE AS k FROM full_cube), e AS (SELECT *, avg(x) OVER (PARTITION BY subject) AS rm, avg(x) OVER (PARTITION BY rater) AS cm FROM full_cube CROSS JOIN g), m AS (SELECT n, k, sum((rm - g) * (rm - g)) / (n - 1) AS msr, sum((cm - g) * (cm - g)) / (k - 1) AS msc, sum((x - rm - cm + g) * (x - rm - cm + g)) / ((n - 1) * (k - 1)) AS mse FROM e GROUP BY n, k) SELECT n::BIGINT AS n, k::BIGINT AS k, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc1, round((msr - mse) / (msr + (msc - mse) / n), 6) AS icck, round(msr / mse, 6) AS f FROM m")
def icc_two_way(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.icc_agreement(_cube(spark, d), "subject", "rater", "x").select("n", "k", "icc1", "icck", "f"), "icc1", "icck", "f")


@query()
def reliability_report(spark: SparkSession, d: str) -> DataFrame:
    """Agreement with interval and p; no SQL, as the F quantile has none: tests hold it against a hand-computed case."""
    return stats.icc_agreement(_cube(spark, d), "subject", "rater", "x")


@query()
def normality_by_generator(spark: SparkSession, d: str) -> DataFrame:
    """Shapiro-Wilk of the mean correlation per metric and target: as many values a generator as the specification has pairs."""
    means = _correlations(spark, d).groupBy("generator", "metric", "target").agg(F.avg("rho").alias("x"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = stats.shapiro_wilk(pdf["x"])
        return pd.DataFrame({"generator": [pdf["generator"].iloc[0]], "n": [len(pdf)], "w": [w], "p": [p]})

    return means.groupBy("generator").applyInPandas(test, "generator string, n bigint, w double, p double")


@query("WITH v AS (SELECT l_returnflag AS g, l_extendedprice AS t, l_quantity * 1500.0 AS p FROM lineitem) SELECT g, round(avg(abs(t - p)), 4) AS mae, round(sqrt(avg((t - p) * (t - p))), 4) AS rmse, round(1 - sum((t - p) * (t - p)) / (sum(t * t) - sum(t) * sum(t) / count(*)), 6) AS r2 FROM v GROUP BY g")
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = stats.error_metrics(F.col("l_extendedprice"), F.col("l_quantity") * 1500.0)
    out = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(*[v.alias(k) for k, v in m.items()])
    return rounded(rounded(out, "mae", "rmse", places=4), "r2")


@query("WITH v AS (SELECT l_shipmode AS g, l_extendedprice - l_quantity * 1500.0 AS e, l_extendedprice AS t FROM lineitem) SELECT g, round(avg(CASE WHEN abs(e) <= 5000 THEN 1 ELSE 0 END), 6) AS within, round(quantile_cont(abs(e), 0.5), 4) AS mad, round(avg(CASE WHEN e > 0 THEN 1 ELSE 0 END), 6) AS upward, round(avg(e), 4) AS mean_delta FROM v GROUP BY g".replace("l_shipmode", "l_linestatus"))
def tolerance_and_direction(spark: SparkSession, d: str) -> DataFrame:
    """Share within tolerance, median absolute deviation, directional success and mean signed change."""
    e = F.col("l_extendedprice") - F.col("l_quantity") * 1500.0
    out = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("g")).agg(
        F.round(F.avg((F.abs(e) <= 5000).cast("int")), 6).alias("within"), F.round(F.percentile(F.abs(e), 0.5), 4).alias("mad"), F.round(F.avg((e > 0).cast("int")), 6).alias("upward"), F.round(F.avg(e), 4).alias("mean_delta")
    )
    return out


@query("WITH h AS (SELECT l_returnflag AS g, least(floor(l_discount / (0.1 / 10)), 9)::INT AS b, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1 GROUP BY 1, 2) SELECT g, b AS bin, n FROM h")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(table(spark, d, "lineitem").withColumn("g", F.col("l_returnflag")), "l_discount", 10, 0.0, 0.1, "g")


@query("WITH h AS (SELECT l_returnflag AS g, least(floor(l_quantity / (50.0 / 8)), 7)::INT AS b, count(*) + 1e-10 AS c FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2), t AS (SELECT g, sum(c) AS s FROM h GROUP BY 1) SELECT g, round(-sum(c / s * ln(c / s)), 6) AS entropy FROM h JOIN t USING (g) GROUP BY g")
def histogram_entropy(spark: SparkSession, d: str) -> DataFrame:
    h = stats.histogram(table(spark, d, "lineitem").withColumn("g", F.col("l_returnflag")), "l_quantity", 8, 0.0, 50.0, "g")
    wide = h.groupBy("g").agg(F.collect_list("n").alias("counts"))  # at most one entry per bin
    return wide.select("g", F.round(entropy_from_counts(F.col("counts")), 6).alias("entropy"))


@query(f"WITH {FEATURES_SQL}, v AS (SELECT n_words AS x, digit_share AS y FROM features WHERE n_words IS NOT NULL), e AS (SELECT list_distinct(quantile_cont(x, [{', '.join(str(i / 10) for i in range(11))}])) AS edges FROM v), b AS (SELECT greatest(len(list_filter(edges, lambda z: z < x)) - 1, 0)::INT AS bin, x, y FROM v CROSS JOIN e) SELECT bin, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM b GROUP BY bin")
def decile_calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.quantile_bins(features(spark, d), "n_words", 10, "digit_share"), "mean_x", "mean_y")


@query("WITH v AS (SELECT p_brand AS g, p_partkey % 5 AS fold, p_retailprice AS y FROM part), t AS (SELECT g, fold, sum(y) AS s, count(*) AS n FROM v GROUP BY 1, 2), o AS (SELECT a.g, a.fold, sum(b.s) / sum(b.n) AS guess FROM t a JOIN t b ON a.g = b.g AND a.fold <> b.fold GROUP BY 1, 2) SELECT count(*) AS n, round(1 - sum((y - guess) * (y - guess)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2 FROM v JOIN o USING (g, fold)")
def r2_group_mean_cv(spark: SparkSession, d: str) -> DataFrame:
    """R squared of the group mean as predictor, each fold predicted from the others: group totals less the fold's own."""
    v = table(spark, d, "part").select(F.col("p_brand").alias("g"), (F.col("p_partkey") % 5).alias("fold"), F.col("p_retailprice").alias("y"))
    cells = v.groupBy("g", "fold").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("g")  # a row per fold
    guess = cells.select("g", "fold", ((F.sum("s").over(w) - F.col("s")) / (F.sum("c").over(w) - F.col("c"))).alias("guess"))
    m = stats.error_metrics(F.col("y"), F.col("guess"))
    return v.join(guess, ["g", "fold"]).agg(F.count(F.lit(1)).alias("n"), F.round(m["r2"], 6).alias("r2"))


@query("WITH v AS (SELECT o_orderpriority[1]::INT AS level, year(o_orderdate) AS unit, avg(o_totalprice) AS x FROM orders GROUP BY 1, 2), s AS (SELECT unit, x - lag(x) OVER (PARTITION BY unit ORDER BY level) AS d FROM v), c AS (SELECT count(*) FILTER (WHERE d > 0) AS up, count(*) FILTER (WHERE d < 0) AS down, count(d) AS n FROM s) SELECT up, down, n, CASE WHEN up / n >= 0.75 THEN 'strong' WHEN up > down THEN 'partial' ELSE 'failure' END AS status FROM c")
def level_monotonicity(spark: SparkSession, d: str) -> DataFrame:
    """Signs of the steps between neighbouring levels within each unit."""
    v = table(spark, d, "orders").groupBy(F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.year("o_orderdate").alias("unit")).agg(F.avg("o_totalprice").alias("x"))
    step = v.select((F.col("x") - F.lag("x").over(Window.partitionBy("unit").orderBy("level"))).alias("d"))
    c = step.agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count("d").alias("n"))
    return c.withColumn("status", stats.monotone_status(F.col("up"), F.col("down"), F.col("n")))


_BASE = ["n_words", "digit_share", "punct_share", "upper_share"]


def _rho_sql(split: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS baseline, corr(x, y) AS rho FROM (SELECT {mid_rank_sql(c)} AS x, {mid_rank_sql('n_letters')} AS y FROM features WHERE split = '{split}' AND n_letters IS NOT NULL)" for c in _BASE)


@query(f"WITH {FEATURES_SQL}, dev AS ({_rho_sql('dev')}), test AS ({_rho_sql('test')}), pick AS (SELECT baseline, rho FROM dev ORDER BY abs(rho) DESC, baseline LIMIT 1) SELECT pick.baseline, round(pick.rho, 6) AS dev_rho, round(test.rho, 6) AS test_rho FROM pick JOIN test USING (baseline)")
def baseline_select_on_dev(spark: SparkSession, d: str) -> DataFrame:
    """The baseline with the largest absolute correlation on development rows (first name on ties), judged on test rows."""
    rho = ranks.rank_correlations(features(spark, d).where("n_letters is not null"), [*_BASE, "n_letters"], "split").where(F.col("b") == "n_letters").where(F.col("a") != "n_letters")
    dev = rho.where("split = 'dev'").orderBy(F.desc(F.abs("rho")), "a").limit(1).select(F.col("a").alias("baseline"), F.col("rho").alias("dev_rho"))
    test = rho.where("split = 'test'").select(F.col("a").alias("baseline"), F.col("rho").alias("test_rho"))
    return rounded(dev.join(test, "baseline"), "dev_rho", "test_rho")


@query()
def decision_status_ladder_full(spark: SparkSession, d: str) -> DataFrame:
    """``decision_status_ladder`` with a cluster-bootstrap interval for each proxy and family and with q-values over all pairs."""
    return status_ladder(complete(spark, d), PROXIES, TARGETS, "n_letters", "cluster", "category", ["en", "de", "fr", "es", "zh"], 2000)


def status_ladder(df: DataFrame, proxies: list, targets: list, nominal: str, cluster: str, family: str, families: list, draws: int) -> DataFrame:
    """(proxy, rho, low, q, margin, association, selectivity, family, overall). Families of fewer than 10 rows are left aside."""
    spark = df.sparkSession
    pairs = ranks.rank_correlations(df, [*proxies, *targets]).where(F.col("a").isin(proxies) & F.col("b").isin(targets)).select("a", "b", "rho").collect()
    n = df.dropna(subset=[*proxies, *targets]).count()
    # a pair without a correlation, a constant input, has p 1
    tests = spark.createDataFrame([(r["a"], r["b"], r["rho"], ranks.spearman_p(r["rho"], n) if r["rho"] is not None else 1.0) for r in pairs], "proxy string, target string, rho double, p double")
    told = ranks.benjamini_hochberg(tests, "p")
    size, is_nominal = F.abs("rho"), F.col("target") == nominal
    m = told.groupBy("proxy").agg(*[F.max(F.when(is_nominal, F.col(c))).alias(c) for c in ("rho", "q")], (F.max(F.when(is_nominal, size)) - F.max(F.when(~is_nominal, size))).alias("margin"))

    def lower(rows: DataFrame, proxy: str) -> float | None:
        r = resample.percentile_interval(resample.cluster_bootstrap_spearman(rows, proxy, nominal, cluster, draws), "rho").first()
        return r["low"] if r else None

    lows = spark.createDataFrame([(p, lower(df, p)) for p in proxies], "proxy string, low double")
    parts = []
    for f in families:
        rows = df.where(F.col(family) == f).dropna(subset=[*proxies, nominal])
        if rows.count() >= 10:
            rho = {r["a"]: r["rho"] for r in ranks.rank_correlations(rows, [*proxies, nominal]).where(F.col("b") == nominal).collect()}
            parts += [(p, rho.get(p), lower(rows, p)) for p in proxies]
    per = spark.createDataFrame(parts, "proxy string, f_rho double, f_low double").join(m.select("proxy", "q"), "proxy")
    good = F.coalesce(stats.association_status(F.col("f_rho"), F.col("f_low"), F.col("q")), F.lit("failure")) != "failure"
    g = per.groupBy("proxy").agg(F.count_if(good).alias("good"), F.count(F.lit(1)).alias("k"))
    s = m.join(lows, "proxy").join(g, "proxy", "left").fillna(0, subset=["good", "k"])
    s = s.withColumns({"association": stats.association_status(F.col("rho"), F.col("low"), F.col("q")), "selectivity": stats.selectivity_status(F.col("margin")), "family": stats.family_status(F.col("good"), F.col("k"))})
    s = s.withColumn("overall", stats.overall_status(F.col("association"), F.col("margin"), F.col("family")))
    return rounded(s.select("proxy", "rho", "low", "q", "margin", "association", "selectivity", "family", "overall"), "rho", "low", "q", "margin")
