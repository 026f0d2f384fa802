"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from . import audit_queries, base, graph_queries, match_queries, mechanism_queries, prose_queries, record_queries, release_queries, review_queries, scalar_queries, scale_queries, text_queries  # noqa: F401  they register themselves

QUERIES, ORACLES = base.QUERIES, base.ORACLES
