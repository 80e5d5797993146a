"""All queries of the array engine by name, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from lattiq.plans import io_queries, rowset_queries, stats_queries, udf_queries  # noqa: F401  each module registers its queries
from lattiq.plans.base import REGISTRY, Query


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in REGISTRY.items() if s}
