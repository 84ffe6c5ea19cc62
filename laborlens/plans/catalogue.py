"""All registered queries, gathered from the plan modules."""

from __future__ import annotations

from laborlens.plans import (  # noqa: F401
    ingest_queries, job_queries, search_queries, skill_queries, text_queries,
)
from laborlens.plans.tables import ORACLES, REGISTRY


def queries() -> dict:
    return dict(REGISTRY)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
