"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Each query is written to a no-op sink, so all its rows and columns are computed. One untimed query warms the session up.
"""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

from vellum.plans import registry
from vellum.session import build_session

CORE = (
    "composite_score_by_lang",
    "metric_contribution_long",
    "feature_health_gate",
    "score_distribution_health",
    "association_matrix",
    "spearman_matrix_by_split",
    "category_summary",
    "leave_one_category_out",
    "validated_join",
    "key_reconciliation",
    "first_per_group",
    "top_n_per_group",
    "quantile_vector",
    "pivot_means",
    "anova_oneway",
    "kruskal_wallis",
    "icc_two_way",
    "cluster_bootstrap_rho",
    "exact_duplicate_groups",
    "near_duplicate_pairs",
    "stratified_split",
    "leakage_report",
    "histogram_entropy",
    "event_sessions",
    "math_suite",
    "p4_found",
    "p4_profile",
)
LLM = ("p1_found", "p2_found", "p3_found", "p5_found", "p6_ids", "p7_found", "p8_found")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(cpus=int(os.environ.get("BENCH_CPUS", 8)))
    spark.sparkContext.setLogLevel("ERROR")
    found = dict(registry.queries())
    names = list(CORE)
    if importlib.util.find_spec("vellum.llm") is not None:
        found |= importlib.import_module("vellum.llm.queries").queries()
        names += LLM
    times = {}
    found["category_summary"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        began = time.perf_counter()
        found[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
