"""Queries of designs, rasters, manifests, result assembly, sources and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.reading import read_label
from vellum.operators import generate, manifest, raster
from vellum.plans.base import FEATURES_SQL, features
from vellum.plans.scoring_queries import rounded
from vellum.session import Scratch, shared_dir, spread, table
from vellum.sources import io
from vellum.streaming import events as windows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# --- designs ----------------------------------------------------------------------------------------------------------

_PAYLOAD = "'{\"construct\": \"' || construct || '\", \"family\": \"' || family || '\", \"index\": ' || idx || ', \"level\": ' || level || ', \"seed\": ' || seed || '}'"
_DESIGN = f"""g AS (SELECT s.seed::INT AS seed, c.construct, l.level::INT AS level, 0 AS idx FROM range(25) s(seed) CROSS JOIN (VALUES {", ".join(f"('{c}')" for c in generate.CONSTRUCTS)}) c(construct) CROSS JOIN range(5) l(level)
  UNION ALL SELECT (i % 25)::INT, 'interaction', -1, i::INT FROM range(800) r(i)),
 d AS (SELECT *, CASE WHEN seed < 10 THEN 'A' WHEN seed < 15 THEN 'B' ELSE 'C' END AS family FROM g),
 e AS (SELECT *, ('0x' || substr(sha256({_PAYLOAD}), 1, 8))::BIGINT AS image_seed FROM d)"""


@query(f"WITH {_DESIGN} SELECT family || '_' || construct || '_L' || CASE WHEN level < 0 THEN 'x' ELSE level::VARCHAR END || '_S' || seed || '_I' || lpad(idx::VARCHAR, 5, '0') AS image_id, family, construct, level, seed, idx, image_seed FROM e")
def factorial_design(spark: SparkSession, d: str) -> DataFrame:
    return generate.factorial_design(spark)


def _param(c: str) -> str:
    return f"round(CASE WHEN construct = '{c}' THEN level / 4.0 ELSE 0.5 END + (('0x' || substr(md5('{c}' || image_seed), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5) * 0.1, 6) AS p_{c}"


@query(f"WITH {_DESIGN} SELECT image_seed, {', '.join(_param(c) for c in generate.CONSTRUCTS)} FROM e WHERE level >= 0")
def generator_parameters(spark: SparkSession, d: str) -> DataFrame:
    cols = [f"p_{c}" for c in generate.CONSTRUCTS]
    return rounded(generate.parameters(generate.factorial_design(spark)).where("level >= 0").select("image_seed", *cols), *cols)


@query("WITH v AS (SELECT i AS row, (i % 5)::INT AS a, ((i // 5) % 5)::INT AS b, ((i // 25) % 5)::INT AS c FROM range(125) r(i)), w AS (SELECT *, (a + b + c) % 5 AS d, (a + 2 * b + 3 * c) % 5 AS e FROM v) SELECT row, a * 25.0 AS target_a, b * 25.0 AS target_b, c * 25.0 AS target_c, d * 25.0 AS target_d, e * 25.0 AS target_e FROM w")
def orthogonal_targets(spark: SparkSession, d: str) -> DataFrame:
    return generate.level_targets(generate.orthogonal_design(spark))


_B = "('0x' || substr(md5('{k}:' || s || ':' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_BOXES = f"v AS (SELECT s, i, {_B.format(k='x')} * 0.7 AS x0, {_B.format(k='y')} * 0.7 AS y0, {_B.format(k='w')} * 0.3 AS w, {_B.format(k='h')} * 0.3 AS h FROM range(200) a(s) CROSS JOIN range(6) b(i)), bx AS (SELECT *, x0 + w AS x1, y0 + h AS y1 FROM v)"


@query(f"WITH {_BOXES}, o AS (SELECT a.s, sum(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS overlap FROM bx a JOIN bx b ON a.s = b.s AND a.i < b.i GROUP BY 1), c AS (SELECT s, count(*) AS n_boxes, sum(w * h) AS covered FROM bx GROUP BY 1) SELECT s AS scene, n_boxes, round(overlap, 6) AS overlap, round(greatest(0, 1 - (covered - overlap)), 6) AS whitespace FROM c JOIN o USING (s)")
def scene_overlap(spark: SparkSession, d: str) -> DataFrame:
    from vellum.functions.exprs import hash_uniform

    base = spark.range(200).toDF("scene").crossJoin(F.broadcast(spark.range(6).toDF("i")))
    u = lambda k: hash_uniform(F.concat_ws(":", F.lit(k), "scene", "i"))
    boxes = base.withColumns({"x0": u("x") * 0.7, "y0": u("y") * 0.7}).withColumns({"x1": F.col("x0") + u("w") * 0.3, "y1": F.col("y0") + u("h") * 0.3})
    return rounded(generate.scene_overlap(boxes, "scene", "i"), "overlap", "whitespace")


# --- rasters: an embedding as 8 x 8 cells -----------------------------------------------------------------------------


def _rasters(spark: SparkSession, d: str) -> DataFrame:
    """Three channels of 8 x 8 bytes per vector: its values, the values in reverse and their absolute values."""
    e = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(127 + 400 * x.cast("double")).cast("int"))))
    pixels = F.zip_with(e, F.reverse(e), lambda a, b: F.concat(F.hex(a + 256), F.hex(b + 256), F.hex(F.abs(a - 127) + 256)))
    # each byte is written as three digits of 256 + value, of which the first is dropped
    text = F.regexp_replace(F.array_join(pixels, ""), "1(..)", "$1")
    return spread(table(spark, d, "embeddings")).select("vec_id", F.unhex(text).alias("data"), F.lit(8).alias("height"), F.lit(8).alias("width"))


@query()
def raster_features(spark: SparkSession, d: str) -> DataFrame:
    """The 38 descriptors of every raster."""
    return raster.describe(_rasters(spark, d), "vec_id", raster.all_features)


@query()
def raster_fast_features(spark: SparkSession, d: str) -> DataFrame:
    return raster.describe(_rasters(spark, d), "vec_id", raster.fast_features)


@query()
def operational_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return raster.describe(_rasters(spark, d), "vec_id", raster.operational_features)


@query()
def image_stability(spark: SparkSession, d: str) -> DataFrame:
    """Per benign transform and level: mean and median absolute change of a few descriptors."""
    cols = ["saturation_mean", "lightness_contrast", "gradient_energy", "symmetry"]
    pick = lambda img: {c: v for c, v in raster.basic_features(img).items() if c in cols}
    base = raster.describe(_rasters(spark, d), "vec_id", pick)
    changed = raster.variants(_rasters(spark, d), "vec_id", raster.STABILITY).withColumn("id", F.concat_ws("|", "vec_id", "transform", "level"))
    after = raster.describe(changed, "id", pick).select(F.split_part("id", F.lit("|"), F.lit(1)).cast("bigint").alias("vec_id"), F.split_part("id", F.lit("|"), F.lit(2)).alias("transform"), F.split_part("id", F.lit("|"), F.lit(3)).alias("level"), *[F.col(c).alias(f"{c}_new") for c in cols])
    both = after.join(base, "vec_id")
    aggs = [a for c in cols for a in (F.avg(F.abs(F.col(f"{c}_new") - F.col(c))).alias(f"{c}_mean"), F.percentile(F.abs(F.col(f"{c}_new") - F.col(c)), 0.5).alias(f"{c}_mad"))]
    return both.groupBy("transform", "level").agg(F.count(F.lit(1)).alias("n"), *aggs)


@query()
def image_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Per manipulation and severity: share of rasters whose descriptor moves the expected way, and the mean change."""
    wanted = sorted({c for _, signs in raster.SENSITIVITY.values() for c in signs})
    pick = lambda img: {c: v for c, v in raster.basic_features(img).items() if c in wanted}
    transforms = {(name, str(s)): (lambda img, f=f, s=s: f(img, s)) for name, (f, _) in raster.SENSITIVITY.items() for s in (1, 2, 3)}
    base = raster.describe(_rasters(spark, d), "vec_id", pick)
    changed = raster.variants(_rasters(spark, d), "vec_id", transforms).withColumn("id", F.concat_ws("|", "vec_id", "transform", "level"))
    after = raster.describe(changed, "id", pick).select(F.split_part("id", F.lit("|"), F.lit(1)).cast("bigint").alias("vec_id"), F.split_part("id", F.lit("|"), F.lit(2)).alias("manipulation"), F.split_part("id", F.lit("|"), F.lit(3)).cast("int").alias("severity"), *[F.col(c).alias(f"{c}_new") for c in wanted])
    expected = spark.createDataFrame([(m, c, s) for m, (_, signs) in raster.SENSITIVITY.items() for c, s in signs.items()], "manipulation string, feature string, sign int")
    long = after.join(base, "vec_id").select("manipulation", "severity", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(f"{c}_new") - F.col(c)).alias("delta")) for c in wanted])).alias("e")).select("manipulation", "severity", "e.*")
    return long.join(F.broadcast(expected), ["manipulation", "feature"]).groupBy("manipulation", "feature", "severity").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("delta") * F.col("sign") > 0).cast("int")).alias("success_rate"), F.avg("delta").alias("mean_delta"))


@query()
def perceptual_hashes(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, low, high): the 64 bits of the cosine hash of every raster at its standard size, as two halves of 32."""

    def halves(img):
        bits = raster.perceptual_hash(raster.standardise_size(img, 64))
        return {k: float(sum(int(b) << i for i, b in enumerate(part))) for k, part in (("low", bits[:32]), ("high", bits[32:]))}

    out = raster.describe(_rasters(spark, d), "vec_id", halves)
    return out.select("vec_id", F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: (x::DOUBLE > list_avg(embedding::DOUBLE[]))::INT), '') AS bits FROM embeddings")
def average_hash(spark: SparkSession, d: str) -> DataFrame:
    """64 bits of an 8 x 8 raster: is a cell above the mean? All in the JVM."""
    mean = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("embedding")
    df = table(spark, d, "embeddings").withColumn("mean", mean)
    return df.select("vec_id", F.array_join(F.transform("embedding", lambda x: (x.cast("double") > F.col("mean")).cast("int").cast("string")), "").alias("bits"))


@query("SELECT vec_id, round(1 - list_avg(list_transform(range(64), lambda i: abs(embedding[i + 1]::DOUBLE - embedding[(i // 8) * 8 + 8 - i % 8]::DOUBLE))), 5) AS mirror_similarity FROM embeddings")
def mirror_similarity(spark: SparkSession, d: str) -> DataFrame:
    """One less the mean absolute difference of an 8 x 8 raster and its mirror image."""
    at = lambda i: F.get("embedding", i).cast("double")
    diffs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.abs(at(i) - at(F.floor(i / 8).cast("int") * 8 + 7 - i % 8)))
    return table(spark, d, "embeddings").select("vec_id", F.round(1 - F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x) / 64, 5).alias("mirror_similarity"))


# --- manifests and evidence -------------------------------------------------------------------------------------------


def _by_pass(spark: SparkSession, d: str, listed_by: str) -> DataFrame:
    rows = table(spark, d, "duplicate_groups").where(F.col("listed_by") == listed_by)
    return rows.groupBy(F.col("image_id").alias("file")).agg(F.max("sha256").alias("sha256"), F.count(F.lit(1)).alias("bytes"))


_SIDE = "(SELECT image_id AS file, max(sha256) AS sha, count(*) AS n FROM duplicate_groups WHERE listed_by = '{k}' GROUP BY 1)"


@query(f"SELECT coalesce(e.file, a.file) AS file, CASE WHEN a.file IS NULL THEN 'missing' WHEN e.file IS NULL THEN 'unlisted' WHEN e.sha IS NOT DISTINCT FROM a.sha AND e.n = a.n THEN 'ok' ELSE 'changed' END AS status FROM {_SIDE.format(k='phash_pass')} e FULL JOIN {_SIDE.format(k='avg_hash_pass')} a ON e.file = a.file")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """Digests of one pass verified against those of another."""
    return manifest.verify(_by_pass(spark, d, "phash_pass"), _by_pass(spark, d, "avg_hash_pass"))


@query("SELECT sha256(string_agg(file || ' ' || coalesce(sha || ' ', '') || n, chr(10) ORDER BY file || ' ' || coalesce(sha || ' ', '') || n)) AS digest, count(*) AS n_files FROM " + _SIDE.format(k="phash_pass"))
def manifest_digest(spark: SparkSession, d: str) -> DataFrame:
    return manifest.digest(_by_pass(spark, d, "phash_pass"))


@query()
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of the small table files themselves."""
    return manifest.hash_files(spark, d, "{region,nation,mixture_targets}.parquet")


@query("SELECT 'regions' AS rule, 5.0 AS expected, (SELECT count(*) FROM region)::DOUBLE AS found, (SELECT count(*) FROM region) = 5 AS passed UNION ALL SELECT 'shares', 1.0, (SELECT round(sum(target_share), 9) FROM mixture_targets), (SELECT round(sum(target_share), 9) FROM mixture_targets) = 1 UNION ALL SELECT 'orphans', 0.0, (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)), (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)) = 0")
def evidence_checks(spark: SparkSession, d: str) -> DataFrame:
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    checks = {
        "regions": region.agg(F.count(F.lit(1))),
        "shares": table(spark, d, "mixture_targets").agg(F.round(F.sum("target_share"), 9)),
        "orphans": nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_anti").agg(F.count(F.lit(1))),
    }
    return manifest.evidence(checks, {"regions": 5, "shares": 1, "orphans": 0})


@query("SELECT source FROM mixture_targets WHERE source NOT IN (SELECT DISTINCT replace(lower(trim(source)), '-', '_') FROM documents WHERE source IS NOT NULL)")
def preflight_missing(spark: SparkSession, d: str) -> DataFrame:
    """Required sources that no document has."""
    present = table(spark, d, "documents").select(read_label("source").alias("source")).where("source is not null")
    return manifest.missing_requirements(table(spark, d, "mixture_targets").select("source"), present, "source")


# --- assembly of results ----------------------------------------------------------------------------------------------


@query(f"WITH {FEATURES_SQL} SELECT split, category, count(*) AS n, count(DISTINCT cluster) AS n_clusters FROM features GROUP BY 1, 2")
def analysis_units(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).groupBy("split", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("n_clusters"))


_GEN = "replace(lower(trim(generator)), '-', '_')"


@query(f"WITH v AS (SELECT {_GEN} AS g, metric, target, seed, rho FROM per_seed_external_metrics WHERE generator IS NOT NULL AND trim(generator) <> '' AND abs(rho) <= 1), m AS (SELECT g, metric, target, count(*) AS n, avg(rho) AS rho, avg(CASE WHEN rho > 0 THEN 1 ELSE 0 END) AS positive FROM v GROUP BY 1, 2, 3) SELECT a.g AS generator, b.g AS other, metric, target, a.n, round(a.rho, 6) AS rho, round(b.rho, 6) AS other_rho, round(a.rho - b.rho, 6) AS delta, round(a.positive, 6) AS positive FROM m a JOIN m b USING (metric, target) WHERE a.g < b.g")
def mechanism_crossing(spark: SparkSession, d: str) -> DataFrame:
    """Mean correlation of every metric and target, generator against generator."""
    v = table(spark, d, "per_seed_external_metrics").where("trim(generator) <> '' and abs(rho) <= 1").withColumn("generator", F.expr(_GEN))
    m = v.groupBy("generator", "metric", "target").agg(F.count(F.lit(1)).alias("n"), F.avg("rho").alias("rho"), F.avg((F.col("rho") > 0).cast("int")).alias("positive"))
    o = m.select(F.col("generator").alias("other"), "metric", "target", F.col("rho").alias("other_rho"))
    out = m.join(o, ["metric", "target"]).where("generator < other").withColumn("delta", F.col("rho") - F.col("other_rho"))
    return rounded(out.select("generator", "other", "metric", "target", "n", "rho", "other_rho", "delta", "positive"), "rho", "other_rho", "delta", "positive")


@query("SELECT 'lineitem' AS source, l_returnflag AS unit, 'mean_price' AS metric, round(avg(l_extendedprice), 4) AS value FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'orders', o_orderstatus, 'n', count(*) FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'part', 'all', 'n_categories', count(DISTINCT p_type) FROM part")
def master_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of several tables as long rows, with a sentinel row that only counts categories."""
    line = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("unit")).agg(F.round(F.avg("l_extendedprice"), 4).alias("value")).withColumns({"source": F.lit("lineitem"), "metric": F.lit("mean_price")})
    orders = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("unit")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumns({"source": F.lit("orders"), "metric": F.lit("n")})
    part = table(spark, d, "part").agg(F.countDistinct("p_type").cast("double").alias("value")).withColumns({"source": F.lit("part"), "unit": F.lit("all"), "metric": F.lit("n_categories")})
    return line.unionByName(orders).unionByName(part).select("source", "unit", "metric", "value")


@query("SELECT seed, count(*) AS n, round(avg(rho), 6) AS rho, 'D_metric' AS role, 'v1' AS model FROM per_seed_external_metrics WHERE seed >= 0 AND abs(rho) <= 1 GROUP BY seed")
def decorated_results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows with the constants of their run; the time of the run is left out, as it can't be compared."""
    out = table(spark, d, "per_seed_external_metrics").where("seed >= 0 and abs(rho) <= 1").groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rho"), 6).alias("rho"))
    return out.withColumns({"role": F.lit("D_metric"), "model": F.lit("v1")})


_KEYWORDS = {"counts": ("n_",), "shares": ("share",), "letters": ("upper", "vowel")}


@query("SELECT * FROM (VALUES ('counts', 'n_letters'), ('counts', 'n_words'), ('shares', 'digit_share'), ('shares', 'upper_share'), ('shares', 'punct_share'), ('shares', 'vowel_share'), ('shares', 'bracket_share'), ('shares', 'tilde_share'), ('letters', 'upper_share'), ('letters', 'vowel_share')) t(grp, feature)")
def feature_group_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Feature groups found by keywords in column names, at plan time."""
    names = [c for c, t in features(spark, d).dtypes if t == "double"]
    rows = [(g, c) for g, words in _KEYWORDS.items() for c in names if any(w in c for w in words)]
    return spark.createDataFrame(rows, "grp string, feature string")


# --- sources ----------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nations written as CSV and scanned again with a declared schema."""
    path = f"{Scratch(spark, 'csv').root}/nation"
    io.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return io.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int").select(*[F.col(c).cast(t).alias(c) for c, t in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").dtypes])


@query("SELECT source, max_repeats AS value FROM mixture_targets")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/{Scratch(spark, 'json').root.rsplit('/', 1)[1]}"
    table(spark, d, "mixture_targets").select("source", F.col("max_repeats").alias("value")).write.mode("overwrite").json(path)
    return spark.read.schema("source string, value int").json(path)


@query("SELECT vec_id, len(embedding) AS dims, round(embedding[1]::DOUBLE, 5) AS first, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def dense_matrix_scan(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("bigint").alias("dims"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"), F.round(total, 4).alias("total"))


@query("SELECT generator, printf('%s & $%+.4f$ [%+.4f, %+.4f] \\\\', replace(generator, '_', '\\_'), mean, lo, hi) AS row FROM (SELECT " + _GEN + " AS generator, round(avg(rho), 6) AS mean, round(min(rho), 6) AS lo, round(max(rho), 6) AS hi FROM per_seed_external_metrics WHERE trim(generator) <> '' AND abs(rho) <= 1 GROUP BY 1)")
def latex_rows(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "per_seed_external_metrics").where("trim(generator) <> '' and abs(rho) <= 1").groupBy(F.expr(_GEN).alias("generator")).agg(F.round(F.avg("rho"), 6).alias("mean"), F.round(F.min("rho"), 6).alias("lo"), F.round(F.max("rho"), 6).alias("hi"))
    return io.latex_rows(v, "generator", "mean", "lo", "hi")


# --- event windows: an extension --------------------------------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    out = windows.tumbling_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = windows.session_counts(table(spark, d, "events"), "ts", "user_id")
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
