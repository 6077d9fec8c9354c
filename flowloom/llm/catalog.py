"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from importlib import import_module

from flowloom.llm.registry import ORACLES, QUERIES

AREAS = ["quality_queries", "mixing_queries", "bpe_queries", "secret_queries", "jaccard_queries", "warc_queries", "page_queries", "substring_queries", "fingerprint_queries", "additive_queries", "collocation_queries", "live_digest_queries", "turn_queries"]


def load_catalog():
    """(queries, SQL) of every operator."""
    for area in AREAS:
        import_module(f"flowloom.llm.{area}")
    return dict(QUERIES), dict(ORACLES)
