"""All queries, by area."""

from __future__ import annotations

from importlib import import_module

AREAS = ["cleaning", "graphs", "sequences", "splits", "encoding", "evaluation", "scoring", "files", "variants"]


def load_catalog():
    """(queries, SQL) of every area."""
    for area in AREAS:
        import_module(f"flowloom.catalog.{area}")
    from flowloom.catalog.base import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
