"""Registered queries grouped by subject."""

from __future__ import annotations

import importlib

MODULES = ["panel_queries", "aggregate_queries", "compare_queries", "model_queries", "stack_queries", "draw_queries", "quality_queries"]


def load_catalog():
    from firmlens.catalog import registry

    for module in MODULES:
        importlib.import_module(f"firmlens.catalog.{module}")
    return registry.QUERIES, registry.ORACLES
