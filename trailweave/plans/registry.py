"""All queries of this package but those of the training-data subpackage: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from . import answer_queries, assembly_queries, catalog_queries, connector_queries, detail_queries, export_queries, feed_queries, grid_queries, hike_queries, offline_queries, raster_queries, relation_queries, route_queries, scan_queries, text_queries, transit_queries

QUERIES = {**route_queries.QUERIES, **transit_queries.QUERIES, **catalog_queries.QUERIES, **text_queries.QUERIES, **grid_queries.QUERIES, **assembly_queries.QUERIES, **connector_queries.QUERIES, **hike_queries.QUERIES, **relation_queries.QUERIES, **feed_queries.QUERIES, **raster_queries.QUERIES, **export_queries.QUERIES, **detail_queries.QUERIES, **scan_queries.QUERIES, **answer_queries.QUERIES, **offline_queries.QUERIES}
FLAGSHIP = "route_elevation_summary"
