"""Queries of the relational steps: projections, filters, joins, aggregates, ranking, sets and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellum.functions import exprs
from vellum.operators import joins
from vellum.operators.quantiles import exact_quantiles
from vellum.plans.base import FEATURES_SQL, features
from vellum.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name together with its SQL."""

    def add(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


# --- projections, filters, scalars ------------------------------------------------------------------------------------


@query("SELECT p_partkey AS part_id, p_brand AS cluster, p_type AS category, p_retailprice AS price FROM part")
def project_rename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("cluster"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))


@query("SELECT 'l_quantity' AS name, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'l_extendedprice', round(avg(l_extendedprice), 4) FROM lineitem UNION ALL SELECT 'l_discount', round(avg(l_discount), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6) FROM lineitem")
def numeric_columns(spark: SparkSession, d: str) -> DataFrame:
    """Features are discovered from the schema: doubles only, so no id and no text."""
    df = table(spark, d, "lineitem")
    names = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    means = df.agg(*[F.avg(c).alias(c) for c in names])
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.round(c, 4 if c == "l_extendedprice" else 6).alias("mean")) for c in names])
    return means.select(F.explode(entries).alias("e")).select("e.*")


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.05 AND l_returnflag IN ('A', 'R') GROUP BY l_returnflag")
def filter_masks(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").where(F.col("l_quantity").between(10, 20) & (F.col("l_discount") >= 0.05) & F.col("l_returnflag").isin("A", "R"))
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(f"WITH {FEATURES_SQL}, m AS (SELECT quantile_cont(n_words, 0.5) AS mid FROM features) SELECT CASE WHEN n_words > mid THEN 'dense' ELSE 'sparse' END AS level, count(*) AS n, round(avg(digit_share), 6) AS digit_share FROM features CROSS JOIN m WHERE n_words IS NOT NULL GROUP BY 1")
def conditional_by_median(spark: SparkSession, d: str) -> DataFrame:
    df = features(spark, d).where("n_words is not null")
    mid = exact_quantiles(df, ["n_words"], [0.5]).select(F.col("n_words_q")[0].alias("mid"))
    level = F.when(F.col("n_words") > F.col("mid"), "dense").otherwise("sparse")
    return df.crossJoin(F.broadcast(mid)).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("digit_share"), 6).alias("digit_share"))


PRIORITY = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}


@query("SELECT CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " END AS level, count(*) AS n FROM orders GROUP BY 1")
def dictionary_map(spark: SparkSession, d: str) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return table(spark, d, "orders").groupBy(F.try_element_at(mapping, F.col("o_orderpriority")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_brand || '/' || p_name AS label, 'exact_' || lpad(dense_rank() OVER (ORDER BY p_brand)::VARCHAR, 5, '0') AS group_id, replace(p_brand, 'Brand#', '') AS brand_number, starts_with(p_name, 's') AS small FROM part")
def id_strings(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    # counters run over the distinct labels, a small relation, not over the rows
    brands = part.select("p_brand").distinct().withColumn("k", F.dense_rank().over(Window.orderBy("p_brand")))
    out = part.join(brands, "p_brand")
    return out.select("p_partkey", F.concat_ws("/", "p_brand", "p_name").alias("label"), F.format_string("exact_%05d", "k").alias("group_id"), F.regexp_replace("p_brand", "Brand#", "").alias("brand_number"), F.startswith("p_name", F.lit("s")).alias("small"))


@query("SELECT split_part(image_id, '_', 1) AS source, count(DISTINCT image_id) AS n FROM duplicate_groups GROUP BY 1")
def prefix_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "duplicate_groups").groupBy(F.split_part("image_id", F.lit("_"), F.lit(1)).alias("source")).agg(F.countDistinct("image_id").alias("n"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[0-9]+\.[0-9]+')) AS n_readings, regexp_matches(text, '(?i)\bprotocol\b|\bseed [0-9]+') AS names_protocol FROM documents WHERE regexp_matches(text, '[0-9]+\.[0-9]+')")
def regex_scan(spark: SparkSession, d: str) -> DataFrame:
    """Readings and mentions of a protocol in texts, as a scan for conflicting decision rules does."""
    df = table(spark, d, "documents").where(F.rlike("text", F.lit(r"[0-9]+\.[0-9]+")))
    return df.select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))).alias("n_readings"), F.rlike("text", F.lit(r"(?i)\bprotocol\b|\bseed [0-9]+")).alias("names_protocol"))


BANNED = ("discount print", "free samples", "wholesale")


@query("SELECT doc_id, " + ", ".join(f"contains(lower(text), '{b}') AS has_{b.replace(' ', '_')}" for b in BANNED) + " FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{b}')" for b in BANNED))
def banned_text_scan(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    df = table(spark, d, "documents").where(F.exists(F.array(*[F.lit(b) for b in BANNED]), lambda b: F.contains(low, b)))
    return df.select("doc_id", *[F.contains(low, F.lit(b)).alias(f"has_{b.replace(' ', '_')}") for b in BANNED])


@query("SELECT CASE WHEN gdev_sample_std IS NULL THEN 'null' WHEN isnan(gdev_sample_std) THEN 'nan' ELSE 'number' END AS kind, count(*) AS n, round(sum(CASE WHEN isnan(gdev_sample_std) THEN 0 ELSE least(greatest(gdev_sample_std, 0), 1) END) FILTER (WHERE gdev_sample_std IS NOT NULL), 4) AS total FROM weighted_feature_health GROUP BY 1")
def clip_guard(spark: SparkSession, d: str) -> DataFrame:
    """Clipping leaves NULL and NaN what they are; they don't become a bound."""
    x = exprs.clip(F.col("gdev_sample_std"), 0.0, 1.0)
    kind = F.when(x.isNull(), "null").when(F.isnan(x), "nan").otherwise("number")
    return table(spark, d, "weighted_feature_health").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.nanvl(x, F.lit(0.0))), 4).alias("total"))


@query("SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS hyp, round(ln(l_extendedprice), 6) AS log_price, round(exp(-l_discount), 6) AS decay, round_even(l_quantity / 2, 0) AS half_even, abs(l_quantity - 25) AS distance FROM lineitem")
def math_suite(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.hypot("l_quantity", "l_tax"), 6).alias("hyp"), F.round(F.ln("l_extendedprice"), 6).alias("log_price"),
        F.round(F.exp(-c("l_discount")), 6).alias("decay"), F.bround(c("l_quantity") / 2, 0).alias("half_even"), F.abs(c("l_quantity") - 25).alias("distance"),
    )


@query("SELECT l_orderkey, l_linenumber, round(6 / (1 + exp(-5 * (l_discount - l_tax))) + 1, 6) AS logistic, round(6 / (1 + exp(l_tax - l_discount)) + 1, 6) AS softmax, least(greatest(round_even(2 * (l_discount * 50), 0) / 2, 1), 7) AS half_steps FROM lineitem")
def rating_scales(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(exprs.logistic_scale(a, b), 6).alias("logistic"), F.round(exprs.softmax_scale(a, b), 6).alias("softmax"), exprs.clip(F.bround(2 * (a * 50), 0) / 2, 1.0, 7.0).alias("half_steps"))


@query(f"WITH {FEATURES_SQL} SELECT doc_id, round(least(greatest(4.0 + 10.0 * coalesce(punct_share, 0.05) - 5.0 * coalesce(digit_share, 0.05) + 0.001 * coalesce(n_words, 100), 1), 7), 6) AS theory FROM features")
def theory_score(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic linear rating in [1, 7] with defaults for missing descriptors."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    value = 4.0 + 10.0 * c("punct_share", 0.05) - 5.0 * c("digit_share", 0.05) + 0.001 * c("n_words", 100.0)
    return features(spark, d).select("doc_id", F.round(exprs.clip(value, 1.0, 7.0), 6).alias("theory"))


@query("SELECT doc_id, ('0x' || substr(sha256('{\"id\": ' || doc_id || ', \"source\": \"' || coalesce(source, '') || '\"}'), 1, 8))::BIGINT AS seed FROM documents")
def stable_seeds(spark: SparkSession, d: str) -> DataFrame:
    payload = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "source": "'), F.coalesce("source", F.lit("")), F.lit('"}'))
    return table(spark, d, "documents").select("doc_id", exprs.stable_seed(payload).alias("seed"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS to_first FROM embeddings")
def embedding_cosine(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings")
    first = df.where("vec_id = 0").select(F.col("embedding").alias("first"))
    return df.crossJoin(F.broadcast(first)).select("vec_id", F.round(exprs.norm(F.col("embedding")), 5).alias("norm"), F.round(exprs.cosine(F.col("embedding"), F.col("first")), 5).alias("to_first"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join_fill(spark: SparkSession, d: str) -> DataFrame:
    """Aggregated before the join, so the exchange carries a row per customer."""
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    out = joins.left_join(table(spark, d, "customer").select("c_custkey"), spent, ["c_custkey"])
    return out.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("SELECT o_orderkey, o_totalprice, n_lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def validated_join(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return joins.join_one_to_one(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"])


_ROLE = "replace(lower(trim(role)), '-', '_')"


@query(f"WITH s AS (SELECT image_id, min({_ROLE}) AS role FROM canonical_splits GROUP BY 1), h AS (SELECT image_id, max(sha256) AS sha FROM duplicate_groups GROUP BY 1), a AS (SELECT image_id FROM s UNION SELECT image_id FROM h) SELECT a.image_id, coalesce(s.role, '') AS role, coalesce(h.sha, '') AS sha FROM a LEFT JOIN s USING (image_id) LEFT JOIN h USING (image_id)")
def three_way_left(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "canonical_splits").groupBy("image_id").agg(F.min(F.expr(_ROLE)).alias("role"))
    h = table(spark, d, "duplicate_groups").groupBy("image_id").agg(F.max("sha256").alias("sha"))
    a = s.select("image_id").union(h.select("image_id")).distinct()
    out = a.join(s, "image_id", "left").join(h, "image_id", "left")
    return out.select("image_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("sha", F.lit("")).alias("sha"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) b ON a.k = b.k")
def full_outer_fill(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n_suppliers"))
    return joins.full_outer(a, b, ["k"], {"n_customers": 0, "n_suppliers": 0})


@query("SELECT 'with' AS kind, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'without', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def semi_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    on = c.c_custkey == o.o_custkey
    count = lambda how, kind: c.join(o, on, how).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("left_semi", "with").unionByName(count("left_anti", "without"))


@query("WITH a AS (SELECT image_id, count(*) AS n FROM duplicate_groups GROUP BY 1), b AS (SELECT image_id, count(*) AS n FROM canonical_splits GROUP BY 1) SELECT coalesce(a.image_id, b.image_id) AS image_id, CASE WHEN b.n IS NULL THEN 'only_left' WHEN a.n IS NULL THEN 'only_right' ELSE 'mismatch' END AS status FROM a FULL JOIN b ON a.image_id = b.image_id WHERE a.n IS DISTINCT FROM b.n")
def key_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    per = lambda t: table(spark, d, t).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    return joins.reconcile(per("duplicate_groups"), per("canonical_splits"), "image_id", "n")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) ON o_orderkey = k JOIN (SELECT DISTINCT l_orderkey AS k2 FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = k2")
def align_ids(spark: SparkSession, d: str) -> DataFrame:
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    big = line.where("l_quantity > 45").select(F.col("l_orderkey").alias("k")).distinct()
    back = line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    return joins.align([orders, big, back], "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def unordered_pairs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("a"))
    b = table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").where("a < b").select("a", "b")


@query("SELECT r_name, m AS metric, k AS level FROM region CROSS JOIN (VALUES ('density'), ('order')) t(m) CROSS JOIN range(3) r(k)")
def dimension_product(spark: SparkSession, d: str) -> DataFrame:
    metrics = spark.createDataFrame([("density",), ("order",)], "metric string")
    return table(spark, d, "region").select("r_name").crossJoin(F.broadcast(metrics)).crossJoin(F.broadcast(spark.range(3).toDF("level")))


@query("SELECT p_partkey, coalesce(q, p_size) AS p_size, p_retailprice FROM part LEFT JOIN (SELECT l_partkey, max(l_linenumber) AS q FROM lineitem WHERE l_quantity = 50 GROUP BY 1) ON p_partkey = l_partkey")
def column_override(spark: SparkSession, d: str) -> DataFrame:
    patch = table(spark, d, "lineitem").where("l_quantity = 50").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_linenumber").alias("p_size"))
    return joins.override(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), patch, ["p_partkey"], ["p_size"])


@query("SELECT count(*) AS n FROM (SELECT DISTINCT image_id FROM duplicate_groups WHERE image_id NOT IN (SELECT image_id FROM canonical_splits WHERE image_id IS NOT NULL))")
def incremental_missing(spark: SparkSession, d: str) -> DataFrame:
    todo = joins.missing_only(table(spark, d, "duplicate_groups").select("image_id").distinct(), table(spark, d, "canonical_splits"), ["image_id"])
    return todo.agg(F.count(F.lit(1)).alias("n"))


# --- aggregates, ranking, limits --------------------------------------------------------------------------------------

_AGG = "count(*) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(quantile_cont({c}, 0.5), 6) AS median, round(min({c}), 6) AS lo, round(max({c}), 6) AS hi"


@query(f"WITH {FEATURES_SQL} SELECT category, {_AGG.format(c='n_words')} FROM features WHERE n_words IS NOT NULL GROUP BY category")
def category_summary(spark: SparkSession, d: str) -> DataFrame:
    c = "n_words"
    aggs = [F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("lo"), F.max(c).alias("hi")]
    rows = features(spark, d).where("n_words is not null")
    mid = exact_quantiles(rows, [c], [0.5], "category").select("category", F.col("n_words_q")[0].alias("median"))
    out = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *aggs).join(mid, "category")
    return out.withColumns({k: F.round(k, 6) for k in ("mean", "std", "median", "lo", "hi")})


@query("SELECT listed_by, count(*) AS n_rows, count(phash) AS n_phash, count(DISTINCT image_id) AS n_images FROM duplicate_groups GROUP BY 1")
def count_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "duplicate_groups").groupBy("listed_by").agg(F.count(F.lit(1)).alias("n_rows"), F.count("phash").alias("n_phash"), F.countDistinct("image_id").alias("n_images"))


@query("SELECT l_suppkey, min(l_orderkey) AS first_order, arg_min(l_quantity, (l_orderkey, l_linenumber, l_quantity)) AS first_quantity FROM lineitem GROUP BY 1")
def first_per_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_orderkey").alias("first_order"), F.min_by("l_quantity", F.struct("l_orderkey", "l_linenumber", "l_quantity")).alias("first_quantity"))


@query(f"WITH {FEATURES_SQL}, c AS (SELECT DISTINCT category FROM features WHERE n_words IS NOT NULL) SELECT c.category AS held_out, count(*) AS n, round(avg(n_words), 6) AS mean, round(stddev_samp(n_words), 6) AS std, round(quantile_cont(n_words, 0.5), 6) AS median FROM c JOIN features f ON f.category <> c.category AND n_words IS NOT NULL GROUP BY 1")
def leave_one_category_out(spark: SparkSession, d: str) -> DataFrame:
    """Statistics over all categories but one, from value counts: rows are aggregated once, not once per held-out category."""
    counts = features(spark, d).where("n_words is not null").groupBy("category", F.col("n_words").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.select(F.col("category").alias("held_out")).distinct()
    rest = counts.join(held, counts.category != held.held_out)
    mean = F.sum(F.col("n") * F.col("v")) / F.sum("n")
    out = rest.groupBy("held_out").agg(F.sum("n").alias("m"), mean.alias("mean"), F.sum(F.col("n") * F.col("v") * F.col("v")).alias("sq"), F.percentile("v", 0.5, F.col("n")).alias("median"))
    std = F.sqrt(F.try_divide(F.col("sq") - F.col("m") * F.col("mean") * F.col("mean"), F.col("m") - 1))
    return out.select("held_out", F.col("m").alias("n"), F.round("mean", 6).alias("mean"), F.round(std, 6).alias("std"), F.round("median", 6).alias("median"))


@query("SELECT p_brand, p_name AS mode, n FROM (SELECT p_brand, p_name, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) AS k FROM part GROUP BY 1, 2) WHERE k = 1")
def mode_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent value, the smallest on ties: a max over counts, no window."""
    counts = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("m"), "p_name")).alias("s")).select("p_brand", F.col("s.p_name").alias("mode"), (-F.col("s.m")).alias("n"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 3) AS q25, round(quantile_cont(l_extendedprice, 0.75), 3) AS q75, round(quantile_cont(l_extendedprice, 0.995), 3) AS q995 FROM lineitem GROUP BY 1")
def quantile_vector(spark: SparkSession, d: str) -> DataFrame:
    q = exact_quantiles(table(spark, d, "lineitem"), ["l_extendedprice"], [0.25, 0.75, 0.995], "l_returnflag")
    return q.select("l_returnflag", *[F.round(F.col("l_extendedprice_q")[i], 3).alias(k) for i, k in enumerate(("q25", "q75", "q995"))])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT generator, target, metric, rho FROM (SELECT *, row_number() OVER (PARTITION BY generator, target ORDER BY abs(rho) DESC, metric, rho) AS k FROM (SELECT replace(lower(trim(generator)), '-', '_') AS generator, target, metric, round(avg(rho), 6) AS rho FROM per_seed_external_metrics WHERE generator IS NOT NULL AND trim(generator) <> '' AND abs(rho) <= 1 GROUP BY 1, 2, 3)) WHERE k = 1")
def strongest_metric(spark: SparkSession, d: str) -> DataFrame:
    """The metric with the largest absolute mean correlation per generator and target, the first name on ties."""
    df = table(spark, d, "per_seed_external_metrics").where("trim(generator) <> '' and abs(rho) <= 1").withColumn("generator", F.expr("replace(lower(trim(generator)), '-', '_')"))
    mean = df.groupBy("generator", "target", "metric").agg(F.round(F.avg("rho"), 6).alias("rho"))
    best = mean.groupBy("generator", "target").agg(F.min(F.struct((-F.abs("rho")).alias("a"), "metric", "rho")).alias("s"))
    return best.select("generator", "target", "s.metric", "s.rho")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def top_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE (k - 1) % greatest(n // 2, 1) = 0 AND (k - 1) // greatest(n // 2, 1) < 2")
def strided_pick(spark: SparkSession, d: str) -> DataFrame:
    """Two rows per brand, evenly spaced in key order."""
    w = Window.partitionBy("p_brand")
    df = table(spark, d, "part").withColumns({"k": F.row_number().over(w.orderBy("p_partkey")) - 1, "step": F.greatest(F.expr("count(*) over (partition by p_brand) div 2"), F.lit(1))})
    return df.where("k % step = 0 and k div step < 2").select("p_brand", "p_partkey")


@query("WITH a AS (SELECT l_suppkey AS k, sum(l_quantity) AS x, round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY 1), n AS (SELECT count(*) // 10 AS m FROM a), r AS (SELECT k, row_number() OVER (ORDER BY x DESC, k) AS xt, row_number() OVER (ORDER BY x, k) AS xb, row_number() OVER (ORDER BY y DESC, k) AS yt, row_number() OVER (ORDER BY y, k) AS yb FROM a) SELECT count(*) FILTER (WHERE xt <= m AND yt <= m) AS top_shared, count(*) FILTER (WHERE xb <= m AND yb <= m) AS bottom_shared, max(m) AS m FROM r CROSS JOIN n")
def topk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many suppliers two rankings share among their top and their bottom tenth: cut-offs by limit, then set intersection."""
    a = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("x"), F.round(F.sum("l_extendedprice"), 2).alias("y"))
    m = a.count() // 10
    pick = lambda c, order: a.orderBy(order(c), "k").limit(m).select("k")
    shared = lambda order, name: pick("x", order).join(pick("y", order), "k", "left_semi").agg(F.count(F.lit(1)).alias(name))
    return shared(F.desc, "top_shared").crossJoin(shared(F.asc, "bottom_shared")).withColumn("m", F.lit(m).cast("bigint"))


@query("SELECT p_type, p_brand, p_size, p_partkey FROM part ORDER BY p_type, p_size DESC, p_partkey")
def mixed_sort(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy("p_type", F.desc("p_size"), "p_partkey").select("p_type", "p_brand", "p_size", "p_partkey")


# --- sets and reshaping -----------------------------------------------------------------------------------------------


@query("SELECT 'customer' AS kind, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return c.unionByName(s)


@query("SELECT image_id, phash, loaded_at::VARCHAR AS loaded FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY loaded_at DESC NULLS LAST, phash NULLS LAST) AS k FROM duplicate_groups) WHERE k = 1")
def keep_latest(spark: SparkSession, d: str) -> DataFrame:
    """One row per image, the last loaded: an aggregate with map-side combining in place of a window over all rows."""
    df = table(spark, d, "duplicate_groups")
    order = F.struct(F.col("loaded_at").isNull().alias("a"), (-F.unix_micros(F.col("loaded_at").cast("timestamp"))).alias("b"), F.col("phash").isNull().alias("c"), F.col("phash").alias("p"))
    first = df.groupBy("image_id").agg(F.min_by(F.struct("phash", "loaded_at"), order).alias("s"))
    return first.select("image_id", "s.phash", F.regexp_replace(F.date_format("s.loaded_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"(\.[0-9]*?)0+$|\.$", "$1").alias("loaded"))


@query("SELECT p_brand, p_type FROM part WHERE p_size < 10 INTERSECT SELECT p_brand, p_type FROM part WHERE p_size > 40")
def intersect_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.where("p_size < 10").select("p_brand", "p_type").intersect(p.where("p_size > 40").select("p_brand", "p_type"))


@query("SELECT p_brand, p_type FROM part WHERE p_size < 10 EXCEPT SELECT p_brand, p_type FROM part WHERE p_size > 40")
def difference_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.where("p_size < 10").select("p_brand", "p_type").subtract(p.where("p_size > 40").select("p_brand", "p_type"))


@query("SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def exclusion_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    out = c.where("c_acctbal < 0").select("c_custkey").union(c.where("c_mktsegment = 'BUILDING'").select("c_custkey"))
    return table(spark, d, "orders").join(out, F.col("o_custkey") == F.col("c_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("n"))


EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]


@query("SELECT user_id, " + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{e}'), 6) AS {e}" for e in EVENT_TYPES) + " FROM events GROUP BY user_id")
def pivot_means(spark: SparkSession, d: str) -> DataFrame:
    """Long to wide with the values listed, so no job is spent on finding them."""
    wide = table(spark, d, "events").groupBy("user_id").pivot("event_type", EVENT_TYPES).agg(F.avg("value"))
    return wide.select("user_id", *[F.round(e, 6).alias(e) for e in EVENT_TYPES])


@query("SELECT p_partkey, 'size' AS name, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def melt_columns(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").cast("double").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "name", "value")


@query("SELECT label AS row, i - 1 AS col, round(avg(embedding[i]::DOUBLE), 5) AS value FROM embeddings CROSS JOIN range(1, 65) r(i) GROUP BY 1, 2")
def matrix_to_long(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("col", "x"))
    return cells.groupBy(F.col("label").alias("row"), "col").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("value"))


@query("SELECT (props->>'k')::INT AS k, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
