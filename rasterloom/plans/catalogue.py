"""All core queries and their oracles by name."""

from __future__ import annotations

from rasterloom.plans import annotation_queries, catalog_queries, file_queries, nested_queries, raster_queries

_MODULES = (nested_queries, raster_queries, annotation_queries, catalog_queries, file_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
