"""Problem 4: data quality of the two health tables, load by load, and profiles of whole tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.profile import Rule, load_issues, profile_tables

RULES = {
    "weighted_feature_health": [Rule("n_unique_all", low=1), Rule("gdev_sample_std", low=0)],
    "semantic_health_gate": [Rule("n_unique", low=1, high="fit_rows"), Rule("finite", allowed=("True", "False"))],
}
PROFILED = ("weighted_feature_health", "semantic_health_gate", "duplicate_groups", "canonical_splits", "per_seed_external_metrics", "documents")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = lambda t: load_issues(spark, f"{sf_dir}/{t}.parquet", RULES[t]).select(F.lit(t).alias("table_name"), "column_name", "run_id", "issue")
    with ThreadPoolExecutor(len(RULES)) as side_by_side:  # the tables' jobs run at the same time
        return reduce(DataFrame.unionByName, side_by_side.map(issues, RULES))


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_tables(spark, {t: f"{sf_dir}/{t}.parquet" for t in PROFILED})


def _numeric_sql(table: str, column: str, out: str) -> str:
    return f"""
    SELECT '{table}' AS table_name, '{column}' AS column_name, run_id, min(release_line) AS line, count(*) AS n,
      count(*) FILTER (WHERE {column} IS NULL) AS nulls, count(*) FILTER (WHERE {out}) AS n_out, 0 AS n_odd,
      min({column}) FILTER (WHERE isfinite({column}::DOUBLE)) = max({column}) FILTER (WHERE isfinite({column}::DOUBLE)) AS one,
      quantile_cont({column}::DOUBLE, 0.5) FILTER (WHERE isfinite({column}::DOUBLE)) AS mid, CAST(NULL AS DOUBLE) AS share
    FROM {table} WHERE run_id IS NOT NULL GROUP BY run_id"""


P4_FOUND_SQL = f"""
WITH s AS ({_numeric_sql("weighted_feature_health", "n_unique_all", "n_unique_all < 1")}
  UNION ALL {_numeric_sql("weighted_feature_health", "gdev_sample_std", "gdev_sample_std < 0 OR NOT isfinite(gdev_sample_std)")}
  UNION ALL {_numeric_sql("semantic_health_gate", "n_unique", "n_unique < 1 OR n_unique > fit_rows")}
  UNION ALL SELECT 'semantic_health_gate', 'finite', run_id, min(release_line), count(*), count(*) FILTER (WHERE finite IS NULL), 0,
    count(*) FILTER (WHERE finite NOT IN ('True', 'False')), NULL, NULL,
    count(*) FILTER (WHERE finite = 'True')::DOUBLE / nullif(count(finite), 0)
    FROM semantic_health_gate WHERE run_id IS NOT NULL GROUP BY run_id),
f AS (SELECT *, first_value(mid) OVER w AS mid0, first_value(share) OVER w AS share0 FROM s
  WINDOW w AS (PARTITION BY table_name, column_name, line ORDER BY run_id))
SELECT table_name, column_name, run_id, 'null_rate' AS issue FROM f WHERE nulls > 0.1 * n
UNION ALL SELECT table_name, column_name, run_id, 'range' FROM f WHERE n_out > 0
UNION ALL SELECT table_name, column_name, run_id, 'pattern' FROM f WHERE n_odd > 0
UNION ALL SELECT table_name, column_name, run_id, 'constant' FROM f WHERE one
UNION ALL SELECT table_name, column_name, run_id, 'drift' FROM f WHERE mid > 2 * mid0 OR mid < mid0 / 2 OR abs(share - share0) > 0.25
"""


#: Columns of the profiled tables as (name, kind): kind n for integers, t for timestamps, d for doubles, s for text, o for others.
COLUMNS = {
    "weighted_feature_health": "release_line s,run_id s,version s,proxy s,feature s,nominal_weight d,absolute_weight d,retained o,effective_weight d,n_unique_all n,n_unique_gdev n,gdev_sample_std d,computed_at t,loaded_at t",
    "semantic_health_gate": "release_line s,run_id s,fit_split s,metric s,feature s,weight d,fit_rows n,finite s,n_unique n,sample_std d,responsive s,active_gate_passed s,computed_at t,loaded_at t",
    "duplicate_groups": "image_id s,category s,sha256 s,duplicate_group_id s,phash s,listed_by s,hashed_at t,loaded_at t",
    "canonical_splits": "image_id s,category s,split s,role s,duplicate_group_id s,fold n,d_metric_member o,exclusion_reason s,assigned_at t,loaded_at t",
    "per_seed_external_metrics": "generator s,seed n,metric s,target s,rho d,computed_at t,loaded_at t",
    "documents": "doc_id n,text s,lang s,source s,n_chars n,collected_at t,loaded_at t",
}


def _profile_sql(table: str, name: str, kind: str) -> str:
    value = {"t": f"epoch_us({name})", "d": f"CASE WHEN NOT isnan({name}) THEN {name} END"}.get(kind, name)
    ends = {k: (f"min({value})", f"max({value})") if kind in k else (f"CAST(NULL AS {t})",) * 2 for k, t in (("nt", "BIGINT"), ("d", "DOUBLE"), ("s", "VARCHAR"))}
    pairs = ", ".join(f"{v} AS {n}" for (a, b), x in zip(ends.values(), ("int", "num", "text"), strict=True) for v, n in ((a, f"lo_{x}"), (b, f"hi_{x}")))
    return f"SELECT '{table}' AS table_name, '{name}' AS column_name, count(*) AS n_rows, count(*) - count({name}) AS n_nulls, count(DISTINCT {value}) AS n_distinct, {pairs} FROM {table}"


P4_PROFILE_SQL = " UNION ALL ".join(_profile_sql(t, *c.split()) for t, cs in COLUMNS.items() for c in cs.split(","))

QUERIES = {"p4_found": p4_found, "p4_profile": p4_profile}
SQL = {"p4_found": P4_FOUND_SQL, "p4_profile": P4_PROFILE_SQL}
