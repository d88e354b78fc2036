"""Session, table and scratch-space helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(cpus: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vellum")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only if that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="vellum-scratch-")
    atexit.register(shutil.rmtree, made, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Scratch:
    """Tables written to the shared folder to cut lineage: they survive lost executors, unlike cached blocks."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.clear)  # results are lazy: only the end of the driver shows that nobody reads them any more

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as parquet and read it back. How many rows were written is known without another pass: :func:`rows_of`."""
        path = f"{self.root}/{self.made:04d}"
        self.made += 1
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
        # a copy of the schema spares the footer read of an inferring scan
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._vellum_path, kept._vellum_rows = path, seen
        return kept

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that no later plan reads."""
        path = getattr(df, "_vellum_path", None)
        if path is not None:
            self._delete(path)

    def clear(self) -> None:
        """Delete all tables of this scratch space; a session that has ended already is let be."""
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001
            return

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def rows_of(df: DataFrame) -> int:
    """The number of rows of ``df``; of a kept table it was counted while that was written."""
    seen = getattr(df, "_vellum_rows", None)
    return df.count() if seen is None else seen.get["n"]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if by its estimated size it fits into one scan partition, as a small table in one file does; else unchanged.

    For stages whose cost lies in the CPU. Nothing runs to find out, and larger tables are never shuffled by it.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= most else df
