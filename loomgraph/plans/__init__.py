"""Composed plans: projections of the star-schema tables and registered queries."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("lookup_queries", "overview_queries", "usage_queries", "extract_queries", "graph_queries")


def load_registry():
    """Import every query module and return (queries, oracles)."""
    for name in _MODULES:
        import_module(f"loomgraph.plans.{name}")
    from loomgraph.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
