"""All queries of the reference's operators, with their SQL twins."""

from __future__ import annotations

from formlake.plans import cell_queries, form_queries, join_queries, order_queries, page_queries, parse_queries, rule_queries, signal_queries  # noqa: F401
from formlake.plans.cell_queries import flagship
from formlake.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


__all__ = ["flagship", "oracle_sql", "queries"]
