"""Sources and sinks: delimited text, JSON, configuration, matrices, reports."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV scan with a header and a declared schema, so no pass is spent on inference; a malformed line raises."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_relation(spark: SparkSession, path: str, required: Mapping[str, str]) -> DataFrame:
    """The parquet table at ``path`` if it exists with all required columns, else an empty relation of that schema."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    schema = ", ".join(f"`{c}` {t}" for c, t in required.items())
    try:
        df = spark.read.parquet(path)
    except (AnalysisException, Py4JJavaError):
        return spark.createDataFrame([], schema)
    return df.select(*required) if set(required) <= set(df.columns) else spark.createDataFrame([], schema)


def read_config(path: str) -> dict:
    """A JSON or YAML mapping on the driver; YAML needs its library."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def config_relation(spark: SparkSession, config: Mapping[str, Mapping[str, float]], names: tuple[str, str, str] = ("metric", "feature", "weight")) -> DataFrame:
    """A two-level mapping as a relation."""
    rows = [(a, b, float(v)) for a, terms in config.items() for b, v in terms.items()]
    return spark.createDataFrame(rows, f"{names[0]} string, {names[1]} string, {names[2]} double")


def rename_first(df: DataFrame, candidates: list[str], name: str) -> DataFrame:
    """``df`` with the first of ``candidates`` that it has renamed to ``name``; unchanged if it has none."""
    found = next((c for c in candidates if c in df.columns), None)
    return df.withColumnRenamed(found, name) if found else df


def wide_to_long(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """A wide workbook sheet as long rows while it is read."""
    return df.unpivot(keys, columns, name, value)


def dense_matrix(df: DataFrame, key: str, columns: list[str], out: str = "vector") -> DataFrame:
    """(key, array): rows of a matrix keep their id; position is never a key."""
    return df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias(out))


def write_json(metadata: Mapping, path: str) -> None:
    Path(path).write_text(json.dumps(metadata, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, title: str, most_rows: int = 200) -> str:
    """A report section of a small result; more than ``most_rows`` rows are an error, as a report isn't a dump."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a report table holds at most {most_rows} rows")
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(r[c]) for c in df.columns) + " |" for r in rows)]) + "\n"


def latex_rows(df: DataFrame, label: str, value: str, low: str, high: str) -> DataFrame:
    """(label, row): a table row `label & value [low, high] \\\\` with signs and four decimals."""
    cell = F.format_string("%s & $%+.4f$ [%+.4f, %+.4f] \\\\", F.replace(F.col(label), F.lit("_"), F.lit("\\_")), value, low, high)
    return df.select(label, cell.alias("row"))
