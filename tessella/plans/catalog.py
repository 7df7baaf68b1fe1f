"""All queries of the engine, by name, and their oracles."""

from . import analyze_queries, evidence3d_queries, evidence_queries, gate_queries, governance_queries, protocol_queries, raster_queries, scale_queries, source_queries, static_queries, stream_queries, table_queries, visibility_queries  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
