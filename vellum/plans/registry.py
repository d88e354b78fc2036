"""All queries of the core and the SQL that each is compared with."""

from __future__ import annotations

from vellum.plans import audit_queries, profile_queries, relational_queries, resampling_queries, scoring_queries, split_queries, statistics_queries

MODULES = (audit_queries, profile_queries, relational_queries, resampling_queries, scoring_queries, split_queries, statistics_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
