"""Problem 3: one group key for every image that pairwise match rows tie together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.reading import read_label
from vellum.llm.components import group_memberships, strip_and_compress
from vellum.session import Scratch, table


def image_groups(listings: DataFrame, scratch: Scratch, solver=strip_and_compress) -> DataFrame:
    """(image_id, group_key) of every image with a label, alone in its group or not.

    Rows with a NULL image or without a readable label tie nothing. A label that reads like another image's id ties the two.
    Repeated rows count once; other columns are ignored; an empty table gives an empty result.
    """
    listed = listings.where(F.col("image_id").isNotNull()).select(F.col("image_id").alias("item"), read_label("duplicate_group_id").alias("grp"))
    rows = scratch.keep(listed.distinct())
    named = rows.where("grp is not null")
    labels = named.select("grp").distinct()
    own = rows.select("item").distinct().withColumn("grp", read_label("item")).join(labels, "grp", "left_semi").select("item", "grp")
    return group_memberships(named.unionByName(own).distinct(), scratch, solver).select(F.col("item").alias("image_id"), F.col("label").alias("group_key"))


def tied_images(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``groups`` whose key is shared by two images or more.

    A key with one image names that image, so lone images are left out by an anti join on the unique image id: a group of any
    size stays spread over all tasks.
    """
    groups = scratch.keep(groups)
    lone = groups.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.min("image_id").alias("image_id")).where("n = 1")
    return groups.join(lone.select("image_id"), "image_id", "left_anti").select("group_key", "image_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "p3")
    return tied_images(image_groups(table(spark, sf_dir, "duplicate_groups"), scratch), scratch)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled image with its group key."""
    scratch = Scratch(spark, "p3g")
    return image_groups(table(spark, sf_dir, "duplicate_groups"), scratch)
