"""All registered queries."""

from __future__ import annotations

from factorloom.plans import (  # noqa: F401  (importing registers the queries)
    queries_genome,
    queries_graph,
    queries_groups,
    queries_pipelines,
    queries_sources,
    queries_stats,
)
from factorloom.plans.registry import ORACLE, QUERIES

flagship = queries_pipelines.trait_summary

__all__ = ["ORACLE", "QUERIES", "flagship"]
