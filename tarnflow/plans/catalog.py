"""All registered queries of the engine's own operators."""

from __future__ import annotations

from tarnflow.plans import queries_dataflow, queries_graph, queries_incremental, queries_operators, queries_sources  # noqa: F401  they register themselves
from tarnflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
