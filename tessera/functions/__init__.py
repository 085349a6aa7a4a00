"""Geometry column functions (WKB in ``BinaryType`` columns)."""

from .columns import (
    BBOX_TYPE,
    SQL_FUNCTIONS,
    bbox_of,
    st_area,
    st_astext,
    st_bbox,
    st_clip_polygonal,
    st_geometry_type,
    st_intersection,
    st_intersects,
    st_is_valid,
    st_length,
    st_make_envelope,
    st_make_valid,
    st_multi,
    st_npoints,
    st_num_geometries,
    st_polygon,
    st_polygonal,
)
from .hashing import geohash, geohash_sql, grid_hash, st_geohash, st_grid_hash

__all__ = [
    "BBOX_TYPE", "SQL_FUNCTIONS", "bbox_of", "geohash", "geohash_sql", "grid_hash",
    "st_area", "st_astext", "st_bbox", "st_clip_polygonal", "st_geohash", "st_geometry_type",
    "st_grid_hash", "st_intersection", "st_intersects", "st_is_valid", "st_length",
    "st_make_envelope", "st_make_valid", "st_multi", "st_npoints", "st_num_geometries",
    "st_polygon", "st_polygonal",
]
