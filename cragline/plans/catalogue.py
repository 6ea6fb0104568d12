"""All registered queries outside the optional parts, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cragline.plans import event_queries, field_queries, graph_queries, layer_queries, light_queries, mapping_queries, mosaic_queries, outline_queries, plane_queries, raster_queries, seam_queries, tiling_queries, track_queries

_THEMES = (event_queries, track_queries, raster_queries, graph_queries, tiling_queries, field_queries, mapping_queries, plane_queries, layer_queries, mosaic_queries, seam_queries, light_queries, outline_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for theme in _THEMES for name, query in theme.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for theme in _THEMES for name, sql in theme.ORACLES.items()}
