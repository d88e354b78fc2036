"""Queries of duplicates, groups and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.reading import read_label, read_sha256
from vellum.operators import dedup
from vellum.session import Scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A vector's 256-bit hash: is each of its 64 entries above four thresholds?
CUTS = (-0.1, 0.0, 0.1, 0.2)
#: Wider than the 16 bits of image hashes: these vectors have no copies, and a query should find something.
RADIUS = 58


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def vector_hashes(spark: SparkSession, d: str) -> DataFrame:
    above = lambda cut: F.transform("embedding", lambda x: x > F.lit(cut).cast("float"))
    words = {f"w{i}": dedup.pack_bits(above(c)) for i, c in enumerate(CUTS)}
    return table(spark, d, "embeddings").select("vec_id", "label", *[v.alias(k) for k, v in words.items()])


WORDS = [f"w{i}" for i in range(len(CUTS))]
_FLAGS = "list_concat(" * (len(CUTS) - 1) + ", ".join([f"list_transform(embedding, lambda x: (x > {c}::FLOAT)::INT)" + (")" if i else "") for i, c in enumerate(CUTS)])
_HASHES = f"h AS (SELECT vec_id, label, array_to_string({_FLAGS}, '') AS bits FROM embeddings)"
_PAIRS = f"{_HASHES}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, hamming(a.bits, b.bits) AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE hamming(a.bits, b.bits) <= {RADIUS})"


@query(f"WITH {_PAIRS} SELECT * FROM p")
def near_duplicate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_pairs(vector_hashes(spark, d), "vec_id", WORDS, RADIUS)


@query(f"WITH {_PAIRS} SELECT * FROM p WHERE a % 100 = 0 OR b % 100 = 0")
def focused_near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Ids divisible by 100 as probes against all rows."""
    return dedup.near_pairs(vector_hashes(spark, d), "vec_id", WORDS, RADIUS, probe="vec_id % 100 = 0")


@query(f"WITH RECURSIVE {_PAIRS}, e AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p), r(v, label) AS (SELECT DISTINCT u, u FROM e UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.v) SELECT v, min(label) AS label FROM r GROUP BY v")
def near_duplicate_components(spark: SparkSession, d: str) -> DataFrame:
    return dedup.components(near_duplicate_pairs(spark, d), Scratch(spark, "near"))


@query(f"""WITH RECURSIVE {_PAIRS}, v AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM (SELECT a AS v FROM p UNION SELECT b FROM p)),
  w AS (SELECT v, k, coalesce(list(a) FILTER (WHERE a IS NOT NULL), []) AS below FROM v LEFT JOIN p ON b = v GROUP BY v, k),
  r(k, anchors) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT w.k, CASE WHEN list_has_any(below, anchors) THEN anchors ELSE list_append(anchors, v) END FROM r JOIN w ON w.k = r.k + 1),
  s AS (SELECT unnest(anchors) AS anchor FROM (SELECT anchors FROM r ORDER BY k DESC LIMIT 1))
  SELECT anchor AS v, anchor FROM s UNION ALL SELECT b, min(a) FROM p JOIN s ON a = anchor WHERE b NOT IN (SELECT anchor FROM s) GROUP BY b""")
def near_duplicate_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Order-dependent grouping: the sequential pass in SQL, rounds here."""
    return dedup.greedy_groups(near_duplicate_pairs(spark, d), Scratch(spark, "greedy"))


_SHA = "regexp_replace(lower(trim(sha256)), '^sha256:', '')"
_READ = f"s AS (SELECT image_id, min(CASE WHEN length({_SHA}) = 64 AND NOT starts_with({_SHA}, 'e3b0c44298fc1c14') THEN {_SHA} END) AS sha FROM duplicate_groups WHERE image_id IS NOT NULL GROUP BY 1)"


@query(f"WITH {_READ}, g AS (SELECT sha, min(image_id) AS group_key, count(*) AS n FROM s WHERE sha IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT image_id, group_key, n FROM s JOIN g USING (sha)")
def exact_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    images = table(spark, d, "duplicate_groups").where("image_id is not null").groupBy("image_id").agg(F.min(read_sha256("sha256")).alias("sha"))
    return dedup.exact_groups(images, "image_id", "sha")


_H = "('0x' || substr(md5('split:' || doc_id), 1, 8))::BIGINT"
_STRAT = f"k AS (SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, row_number() OVER (PARTITION BY coalesce(lang, 'none') ORDER BY {_H}, doc_id) AS r, count(*) OVER (PARTITION BY coalesce(lang, 'none')) AS n FROM documents), st AS (SELECT doc_id, lang, source, CASE WHEN r <= floor(0.7::DOUBLE * n + 1e-9) THEN 'dev' WHEN r <= floor((0.7::DOUBLE + 0.15::DOUBLE) * n + 1e-9) THEN 'test' ELSE '' END AS split FROM k)"


def _stratified(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("source", F.lit("none")).alias("source"))
    return dedup.stratified_split(docs, "doc_id", "lang", {"dev": 0.70, "test": 0.15})


@query(f"WITH {_STRAT} SELECT doc_id, split FROM st")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """70 / 15 percent per category; the left-over 15 percent keep an empty split, as a metric set."""
    return _stratified(spark, d).select("doc_id", "split")


@query(f"WITH {_STRAT}, t AS (SELECT doc_id, split, md5(coalesce(text, doc_id::VARCHAR)) AS g FROM st JOIN documents USING (doc_id)), c AS (SELECT g, split, count(*) AS n FROM t GROUP BY 1, 2), m AS (SELECT g, count(*) AS k, arg_min(split, (-n, split)) AS s FROM c GROUP BY 1) SELECT doc_id, CASE WHEN k > 1 THEN CASE WHEN s = '' THEN 'dev' ELSE s END ELSE split END AS split FROM t JOIN m USING (g)")
def duplicate_split_repair(spark: SparkSession, d: str) -> DataFrame:
    """Copies of one text are moved into one split."""
    text = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.col("doc_id").cast("string")).cast("binary")).alias("g"))
    return dedup.repair_splits(_stratified(spark, d).select("doc_id", "split").join(text, "doc_id"), "g").select("doc_id", "split")


_LABEL = "nullif(replace(lower(trim(duplicate_group_id)), '-', '_'), '')"


@query(f"WITH g AS (SELECT {_LABEL} AS grp, min(category) AS c FROM canonical_splits WHERE {_LABEL} IS NOT NULL GROUP BY 1) SELECT grp, ((row_number() OVER (PARTITION BY c ORDER BY ('0x' || substr(md5('fold:' || grp), 1, 8))::BIGINT, grp) - 1) % 5)::INT AS fold FROM g")
def group_kfold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_splits").select(read_label("duplicate_group_id").alias("grp"), "category")
    return dedup.group_folds(rows, "grp", "category", 5)


@query(f"WITH g AS (SELECT {_LABEL} AS grp, count(DISTINCT split) AS k, count(*) AS n FROM canonical_splits WHERE {_LABEL} IS NOT NULL GROUP BY 1) SELECT CASE WHEN starts_with(grp, 'exact_') THEN 'exact' WHEN starts_with(grp, 'near_') THEN 'near' ELSE 'other' END AS kind, count(*) AS n_groups, count(*) FILTER (WHERE k > 1) AS n_spanning, sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS n_rows FROM g GROUP BY 1")
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "canonical_splits").select(read_label("duplicate_group_id").alias("grp"), "split")
    return dedup.leakage_report(rows, "grp")


@query(f"WITH r AS (SELECT image_id, {_LABEL} AS grp, replace(lower(trim(role)), '-', '_') = 'd_stability' AS p FROM canonical_splits) SELECT DISTINCT image_id FROM r WHERE NOT coalesce(p, false) AND grp IN (SELECT grp FROM r WHERE p AND grp IS NOT NULL)")
def protected_group_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Images that share a group with a stability image and so may not be used beside it."""
    rows = table(spark, d, "canonical_splits").select("image_id", read_label("duplicate_group_id").alias("grp"), (read_label("role") == "d_stability").alias("p"))
    return dedup.sharing_group_with(rows, "grp", "p").select("image_id").distinct()


@query("SELECT doc_id, coalesce(row_number() OVER (PARTITION BY coalesce(lang, 'none') ORDER BY ('0x' || substr(md5('sample:' || doc_id), 1, 8))::BIGINT, doc_id) <= 20, false) AS in_sample FROM documents")
def category_sample_flag(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    return dedup.sample_per_category(docs, "doc_id", "lang", 20).select("doc_id", "in_sample")
