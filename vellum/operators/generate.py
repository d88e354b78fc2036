"""Factorial benchmark designs as relations: dimensions crossed, parameters closed-form, seeds from hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.exprs import hash_uniform, stable_seed

FAMILIES = ("A", "B", "C")
CONSTRUCTS = ("clutter", "order", "palette", "salience", "hierarchy")


def factorial_design(spark: SparkSession, levels: int = 5, seeds: int = 25, per_cell: int = 1, interactions: int = 800) -> DataFrame:
    """(image_id, family, construct, level, seed, idx, image_seed): families x constructs x levels x seeds x cell, and interaction scenes at level -1.

    Families own disjoint seeds (40, 20 and 40 percent). ``image_seed`` hashes a canonical payload that names the interaction too, so
    no two scenes share one.
    """
    first, second = seeds * 4 // 10, seeds * 6 // 10
    family = F.when(F.col("seed") < first, "A").when(F.col("seed") < second, "B").otherwise("C")
    constructs = spark.createDataFrame([(c,) for c in CONSTRUCTS], "construct string")
    grid = spark.range(seeds).select(F.col("id").cast("int").alias("seed")).crossJoin(F.broadcast(constructs)).crossJoin(F.broadcast(spark.range(levels).select(F.col("id").cast("int").alias("level"))))
    grid = grid.crossJoin(F.broadcast(spark.range(per_cell).select(F.col("id").cast("int").alias("idx")))).withColumn("family", family)
    extra = spark.range(interactions).select((F.col("id") % seeds).cast("int").alias("seed"), F.lit("interaction").alias("construct"), F.lit(-1).alias("level"), F.col("id").cast("int").alias("idx"))
    rows = grid.unionByName(extra.withColumn("family", family))
    payload = F.format_string('{"construct": "%s", "family": "%s", "index": %d, "level": %d, "seed": %d}', "construct", "family", "idx", "level", "seed")
    name = F.format_string("%s_%s_L%s_S%d_I%05d", "family", "construct", F.when(F.col("level") < 0, "x").otherwise(F.col("level").cast("string")), "seed", "idx")
    return rows.select(name.alias("image_id"), "family", "construct", "level", "seed", "idx", stable_seed(payload).alias("image_seed"))


def parameters(design: DataFrame, levels: int = 5) -> DataFrame:
    """``design`` with generator parameters: the construct's own follows the level, the others sit at the middle with hashed jitter."""
    step = F.col("level") / F.lit(float(levels - 1))
    jitter = lambda name: (hash_uniform(F.concat(F.lit(name), F.col("image_seed").cast("string"))) - 0.5) * 0.1
    own = lambda c: F.when(F.col("construct") == c, step).otherwise(0.5)
    return design.withColumns({f"p_{c}": own(c) + jitter(c) for c in CONSTRUCTS})


def orthogonal_design(spark: SparkSession, levels: int = 5) -> DataFrame:
    """levels^3 rows (row, a, b, c, d, e): three free factors and two that are sums of them modulo the levels; all pairs balanced for a prime number of levels."""
    n = F.col("id")
    a, b, c = (n % levels).cast("int"), (F.floor(n / levels) % levels).cast("int"), (F.floor(n / levels**2) % levels).cast("int")
    return spark.range(levels**3).select(n.alias("row"), a.alias("a"), b.alias("b"), c.alias("c"), ((a + b + c) % levels).alias("d"), ((a + 2 * b + 3 * c) % levels).alias("e"))


def level_targets(design: DataFrame, levels: int = 5) -> DataFrame:
    """Direct targets of an orthogonal design: 100 x level / (levels - 1) per factor."""
    return design.select("row", *[(F.col(f) * 100.0 / (levels - 1)).alias(f"target_{f}") for f in "abcde"])


def scene_overlap(boxes: DataFrame, scene: str, box: str, area: Column | float = 1.0) -> DataFrame:
    """(scene, n_boxes, overlap, whitespace) of boxes (x0, y0, x1, y1): overlap is summed over the pairs of a scene, a handful of boxes."""
    a = boxes.select(scene, F.col(box).alias("i"), *[F.col(k).alias(f"a_{k}") for k in ("x0", "y0", "x1", "y1")])
    b = boxes.select(scene, F.col(box).alias("j"), *[F.col(k).alias(f"b_{k}") for k in ("x0", "y0", "x1", "y1")])
    side = lambda k: F.greatest(F.lit(0.0), F.least(f"a_{k}1", f"b_{k}1") - F.greatest(f"a_{k}0", f"b_{k}0"))
    over = a.join(b, scene).where("i < j").groupBy(scene).agg(F.sum(side("x") * side("y")).alias("overlap"))
    covered = boxes.groupBy(scene).agg(F.count(F.lit(1)).alias("n_boxes"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("covered"))
    whole = area if isinstance(area, Column) else F.lit(float(area))
    overlap = F.coalesce("overlap", F.lit(0.0))
    return covered.join(over, scene, "left").select(scene, "n_boxes", overlap.alias("overlap"), F.greatest(F.lit(0.0), 1.0 - (F.col("covered") - overlap) / whole).alias("whitespace"))
