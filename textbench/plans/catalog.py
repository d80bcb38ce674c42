"""All queries over the given tables, and their SQL."""

from __future__ import annotations

from textbench.plans import dump_queries, file_queries, profile_queries, record_queries, replace_queries, search_queries, sink_queries  # noqa: F401
from textbench.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
