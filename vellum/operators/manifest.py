"""Manifests of files: hashes, verification, digests and evidence rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(file, sha256, bytes) of the files below ``root``, read and hashed by tasks; ``file`` is the path below the root."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    path = F.regexp_replace("path", "^file:/+", "/")
    return found.select(F.when(path.startswith(base), F.substr(path, F.length(base) + 1)).otherwise(path).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(file, status) of every file of either relation (file, sha256, bytes): ok, changed, missing or unlisted."""
    e = expected.select("file", F.col("sha256").alias("_es"), F.col("bytes").alias("_eb"), F.lit(True).alias("_e"))
    a = actual.select("file", F.col("sha256").alias("_as"), F.col("bytes").alias("_ab"), F.lit(True).alias("_a"))
    same = F.col("_es").eqNullSafe(F.col("_as")) & F.col("_eb").eqNullSafe(F.col("_ab"))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unlisted").when(same, "ok").otherwise("changed")
    return e.join(a, "file", "full").select("file", status.alias("status"))


def digest(files: DataFrame) -> DataFrame:
    """One row: the hash of all (file, sha256, bytes) lines in the order of their names. A listing has a line per file."""
    line = F.concat_ws(" ", "file", "sha256", F.col("bytes").cast("string"))
    return files.agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))).cast("binary"), 256).alias("digest"), F.count(F.lit(1)).alias("n_files"))


def evidence(checks: dict[str, DataFrame], expected: dict[str, float]) -> DataFrame:
    """(rule, expected, found, passed): each check is a one-row relation with one number."""
    out = None
    for rule, df in checks.items():
        row = df.select(F.lit(rule).alias("rule"), F.lit(float(expected[rule])).alias("expected"), F.col(df.columns[0]).cast("double").alias("found"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", F.coalesce(F.abs(F.col("expected") - F.col("found")) < 1e-9, F.lit(False)))


def missing_requirements(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Required keys that aren't there."""
    return required.join(present.select(key).distinct(), key, "left_anti")


def fingerprint(rows: DataFrame, key: str, digest_column: str) -> DataFrame:
    """One row that changes with any key or digest and not with row order: counts and two sums of 64-bit hashes."""
    h = F.xxhash64(key, digest_column)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"), F.bit_xor(h).alias("xor"))
