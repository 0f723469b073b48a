"""All queries of the core, and the SQL that each is held against."""

from __future__ import annotations

from warpweft.plans import decision_queries, evidence_queries, phonology_queries, predicate_queries, reading_queries, report_queries, route_queries, text_queries, verdict_queries  # noqa: F401
from warpweft.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
