"""All queries of the engine proper and the SQL that each must equal."""

from __future__ import annotations

from rowloom.plans import audit_queries, dataset_queries, finishing_queries, line_queries, network_queries, polyline_queries, raster_queries, region_queries, shape_queries, table_queries

_PARTS = (line_queries, network_queries, raster_queries, table_queries, audit_queries, shape_queries, polyline_queries, region_queries, dataset_queries, finishing_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
