"""All queries of the library outside llm, with the SQL that checks them."""

from __future__ import annotations

from lumenfold.plans import audit_queries, decision_queries, identity_queries, metric_queries, rollup_queries, sampling_queries, scalar_queries, signal_queries, source_queries  # noqa: F401  they register themselves
from lumenfold.plans.fixtures import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
