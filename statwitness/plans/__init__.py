"""Queries that bind the operators to the provided tables."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["profile_queries", "extract_queries", "hierarchy_queries", "structure_queries", "mapping_queries", "verify_queries", "dimension_queries", "retrieve_queries", "feedback_queries"]


def all_queries():
    from statwitness.plans.registry import REGISTRY

    for m in _MODULES:
        import_module(f"statwitness.plans.{m}")
    return dict(REGISTRY)
