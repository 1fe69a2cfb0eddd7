"""Queries over the driver tables and their SQL, by name."""

from __future__ import annotations

from quillon.plans import change_queries, definition_queries, evidence_queries, field_queries, gate_queries, governance_queries, inventory_queries, link_queries, passage_queries, quantity_queries, record_queries, search_queries, variant_queries  # noqa: F401  each registers its queries

QUERIES, ORACLES = search_queries.QUERIES, search_queries.ORACLES
