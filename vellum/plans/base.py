"""The feature matrix that the queries run on, in Spark and in SQL.

A document stands for an image: its text statistics are the descriptors, its language the category, its source the cluster.
A NULL text gives NULL descriptors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.exprs import hash_int
from vellum.session import table


#: The characters that a share counts.
SHARES = {"digit_share": "0123456789", "upper_share": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "punct_share": ".,;:!?", "vowel_share": "aeiou", "bracket_share": "()[]{}"}


def _share(chars: str) -> str:
    return f"(length(text) - length(translate(text, '{chars}', ''))) * 1e0 / greatest(length(text), 1)"


def _spark_share(chars: str) -> Column:
    """:func:`_share` by what is left without the runs of other characters: Spark's translate looks up every character of a text."""
    others = "[^" + "".join(c if c.isalnum() else f"\\{c}" for c in chars) + "]+"
    return F.length(F.regexp_replace("text", others, "")) * F.lit(1.0) / F.greatest(F.length("text"), F.lit(1))


#: Descriptor -> expression that Spark and other engines read alike; shares have a faster one in Spark.
FEATURES = {
    "n_letters": "length(text) * 1e0",
    "n_words": "(length(text) - length(replace(text, ' ', '')) + 1) * 1e0",
    "digit_share": _share(SHARES["digit_share"]),
    "upper_share": _share(SHARES["upper_share"]),
    "punct_share": _share(SHARES["punct_share"]),
    "vowel_share": _share(SHARES["vowel_share"]),
    "bracket_share": _share(SHARES["bracket_share"]),
    "tilde_share": "(length(text) - length(text)) * 1e0",  # a descriptor that never responds
}
NAMES = list(FEATURES)
CATEGORY = "coalesce(nullif(lower(trim(lang)), ''), 'none')"
CLUSTER = "coalesce(nullif(replace(lower(trim(source)), '-', '_'), ''), 'none')"

#: composite -> {descriptor: (weight, group)}; absolute weights sum to 1.
COMPOSITES = {
    "density": {"n_words": (0.30, "size"), "digit_share": (0.25, "symbols"), "punct_share": (0.25, "symbols"), "upper_share": (-0.20, "case")},
    "order": {"vowel_share": (0.40, "case"), "n_letters": (0.30, "size"), "bracket_share": (-0.15, "symbols"), "tilde_share": (0.15, "symbols")},
    "variety": {"upper_share": (0.50, "case"), "punct_share": (0.30, "symbols"), "vowel_share": (-0.20, "case")},
}

FEATURES_SQL = f"""
features AS (
  SELECT doc_id, {CATEGORY} AS category, {CLUSTER} AS cluster,
    CASE WHEN h % 100 < 70 THEN 'dev' WHEN h % 100 < 85 THEN 'validation' ELSE 'test' END AS split, h,
    {", ".join(f"{e} AS {n}" for n, e in FEATURES.items())}
  FROM (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents)
)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("h", hash_int(F.col("doc_id")))
    split = F.when(F.col("h") % 100 < 70, "dev").when(F.col("h") % 100 < 85, "validation").otherwise("test")
    return docs.select("doc_id", F.expr(CATEGORY).alias("category"), F.expr(CLUSTER).alias("cluster"), split.alias("split"), "h", *[(_spark_share(SHARES[n]) if n in SHARES else F.expr(e)).alias(n) for n, e in FEATURES.items()])


def in_sql(names: list[str], form: str, sep: str = ", ") -> str:
    """``form`` for each name, ``{c}`` standing for it."""
    return sep.join(form.format(c=c) for c in names)
