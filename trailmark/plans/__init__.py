"""Queries over the fixture views, and their SQL."""

from __future__ import annotations

import importlib

from trailmark.plans.registry import ORACLES, QUERIES, Query

MODULES = ("trajectory_queries", "tracklet_queries", "untagged_queries", "classify_queries", "graph_queries", "export_queries", "kernel_queries", "extra_queries")
for _name in MODULES:
    importlib.import_module(f"{__name__}.{_name}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
