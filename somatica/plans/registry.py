"""All queries of the morphometry library with their SQL."""

from __future__ import annotations

from somatica.plans import cell_queries, pixel_queries, raster_queries, session_queries, source_queries

QUERIES = cell_queries.QUERIES | pixel_queries.QUERIES | source_queries.QUERIES | session_queries.QUERIES | raster_queries.QUERIES
SQL = cell_queries.SQL | pixel_queries.SQL | source_queries.SQL | session_queries.SQL | raster_queries.SQL
