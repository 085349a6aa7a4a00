"""Geometry Column functions.

Each ``st_*`` function returns a ``Column``.  Geometry work runs in Arrow
batches on the executors (``arrow_udf``); hashing is plain Spark expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import (BinaryType, BooleanType, DoubleType, IntegerType, StringType,
                               StructField, StructType)

from .. import _ship
from . import batch, wkb

BBOX_FIELDS = ("minx", "miny", "maxx", "maxy")
BBOX_TYPE = StructType([StructField(n, DoubleType()) for n in BBOX_FIELDS])


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bbox_struct(b: np.ndarray) -> pa.Array:
    mask = np.isnan(b[:, 0])
    arrays = [pa.array(b[:, i], mask=mask) for i in range(4)]
    return pa.StructArray.from_arrays(arrays, names=list(BBOX_FIELDS), mask=pa.array(mask))


@arrow_udf(BBOX_TYPE)
def _bbox_udf(g: pa.Array) -> pa.Array:
    return _bbox_struct(batch.bounds(g))


@arrow_udf(BinaryType())
def _clip_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return batch.intersection_batch(a, b, keep_geom_type=True)


@arrow_udf(BinaryType())
def _intersection_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return batch.intersection_batch(a, b, keep_geom_type=False)


@arrow_udf(BinaryType())
def _intersection_nonempty_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return batch.intersection_batch(a, b, keep_geom_type=False, empty_as_null=True)


@arrow_udf(BooleanType())
def _intersects_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return batch.intersects_batch(a, b)


@arrow_udf(DoubleType())
def _area_udf(g: pa.Array) -> pa.Array:
    return batch.area_batch(g)


@arrow_udf(DoubleType())
def _length_udf(g: pa.Array) -> pa.Array:
    return batch.map_rows(g, batch.length_one, pa.float64(), batch.is_convex, 0.0)


@arrow_udf(BooleanType())
def _is_valid_udf(g: pa.Array) -> pa.Array:
    return batch.map_rows(g, batch.is_valid_one, pa.bool_(), batch.is_convex, True)


@arrow_udf(BinaryType())
def _make_valid_udf(g: pa.Array) -> pa.Array:
    return batch.map_rows(g, batch.make_valid_one, pa.binary(), batch.is_convex)


@arrow_udf(BinaryType())
def _make_valid_once_udf(g: pa.Array) -> pa.Array:
    return batch.map_rows(g, batch.make_valid_one, pa.binary(), batch.is_convex)


_make_valid_once_udf = _make_valid_once_udf.asNondeterministic()


@arrow_udf(BinaryType())
def _multi_udf(g: pa.Array) -> pa.Array:
    return batch.map_rows(g, batch.multi_one, pa.binary())


@arrow_udf(BinaryType())
def _polygonal_udf(g: pa.Array) -> pa.Array:
    return batch.map_rows(g, batch.polygonal_one, pa.binary(), batch.is_convex)


@arrow_udf(StringType())
def _geometry_type_udf(g: pa.Array) -> pa.Array:
    return batch.map_rows(g, batch.geometry_type_one, pa.string(), batch.is_convex, "Polygon")


@arrow_udf(IntegerType())
def _num_geometries_udf(g: pa.Array) -> pa.Array:
    return batch.map_rows(g, batch.num_parts_one, pa.int32(), batch.is_convex, 1)


@arrow_udf(IntegerType())
def _num_points_udf(g: pa.Array) -> pa.Array:
    return batch.map_rows(g, batch.num_points_one, pa.int32(), batch.is_rect, 5)


@arrow_udf(StringType())
def _as_text_udf(g: pa.Array) -> pa.Array:
    return batch.map_rows(g, batch.as_text_one, pa.string())


@arrow_udf(BinaryType())
def _envelope_udf(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    cols = [batch.as_array(c) for c in (x0, y0, x1, y1)]
    boxes = np.column_stack([c.to_numpy(zero_copy_only=False) for c in cols]).astype(np.float64)
    nulls = np.zeros(len(boxes), dtype=bool)
    for c in cols:
        if c.null_count:
            nulls |= c.is_null().to_numpy(zero_copy_only=False)
    vals = batch.rect_bytes(np.nan_to_num(boxes))
    return batch.binary([None if m else v for v, m in zip(vals, nulls)])


@arrow_udf(BinaryType())
def _polygon_udf(rings: pa.Array) -> pa.Array:
    return batch.polygon_from_rings(rings)


def _call(udf, *cols) -> Column:
    _ship.ensure()
    return udf(*[_c(c) for c in cols])


# ------------------------------------------------------------ public API

def st_bbox(g) -> Column:
    """Bounding box struct ``minx, miny, maxx, maxy``; NULL for NULL/empty."""
    return _call(_bbox_udf, g)


def st_intersects(a, b) -> Column:
    """Whether two geometries share a point, boundary included."""
    return _call(_intersects_udf, a, b)


def st_intersection(a, b) -> Column:
    """Shared geometry; touching parts come back as lines or points."""
    return _call(_intersection_udf, a, b)


def st_clip_polygonal(a, b) -> Column:
    """Polygonal part of the intersection, NULL when there is none."""
    return _call(_clip_udf, a, b)


def st_area(g) -> Column:
    return _call(_area_udf, g)


def st_length(g) -> Column:
    return _call(_length_udf, g)


def st_is_valid(g) -> Column:
    return _call(_is_valid_udf, g)


def st_make_valid(g) -> Column:
    """Repair invalid polygons; valid input comes back unchanged (own cheap check)."""
    return _call(_make_valid_udf, g)


def make_valid_once(g) -> Column:
    """``st_make_valid`` as an expression that is evaluated once, however often its column is used."""
    return _call(_make_valid_once_udf, g)


def _byte(g: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(g, at, 1)), 16, 10).cast("int")


def _type_code(g: Column) -> Column:
    """Base WKB type code from the header, without leaving the JVM."""
    little = _byte(g, 1) == 1
    low, high = F.when(little, _byte(g, 2)).otherwise(_byte(g, 5)), F.when(little, _byte(g, 3)).otherwise(_byte(g, 4))
    return (low + 256 * high) % 1000


def st_multi(g) -> Column:
    """Promote Polygon to MultiPolygon: a new header before the same bytes, whatever their order and dimensions."""
    g = _c(g)
    little = _byte(g, 1) == 1
    code = F.when(little, _byte(g, 2)).otherwise(_byte(g, 5)) + 3
    code = F.unhex(F.lpad(F.hex(code), 2, "0"))
    kind = F.when(little, F.concat(F.substring(g, 1, 1), code, F.substring(g, 3, 3))).otherwise(F.concat(F.substring(g, 1, 4), code))
    has_srid = F.when(little, _byte(g, 5)).otherwise(_byte(g, 2)).bitwiseAND(F.lit(0x20)) != 0
    head = F.concat(kind, F.when(has_srid, F.substring(g, 6, 4)).otherwise(F.unhex(F.lit(""))))
    empty = F.octet_length(g) <= F.when(has_srid, 13).otherwise(9)
    one = F.when(little, F.unhex(F.lit("01000000"))).otherwise(F.unhex(F.lit("00000001")))
    multi = F.when(empty, F.concat(head, F.unhex(F.lit("00000000")))).otherwise(F.concat(head, one, g))
    return F.when(_type_code(g) == wkb.POLYGON, multi).otherwise(g)


def st_polygonal(g) -> Column:
    """Polygonal parts only; NULL if there are none."""
    return _call(_polygonal_udf, g)


def st_geometry_type(g) -> Column:
    """OGC type name, e.g. ``Polygon``."""
    names = F.array(*(F.lit(wkb.TYPE_NAMES.get(i, "Unknown")) for i in range(max(wkb.TYPE_NAMES) + 1)))
    g = _c(g)
    return F.when(g.isNotNull(), F.coalesce(F.get(names, _type_code(g)), F.lit("Unknown")))


def st_num_geometries(g) -> Column:
    return _call(_num_geometries_udf, g)


def st_npoints(g) -> Column:
    return _call(_num_points_udf, g)


def st_astext(g) -> Column:
    return _call(_as_text_udf, g)


def st_make_envelope(minx, miny, maxx, maxy) -> Column:
    """Axis-aligned rectangle polygon from four numeric columns."""
    return _call(_envelope_udf, *(_c(c).cast("double") for c in (minx, miny, maxx, maxy)))


def st_polygon(rings) -> Column:
    """Polygon from ``array<array<double>>``: one flat ``x0, y0, x1, y1, ...`` list per ring, shell first."""
    return _call(_polygon_udf, rings)


def bbox_of(minx, miny, maxx, maxy) -> Column:
    """Bounding-box struct from four numeric columns (no UDF)."""
    return F.struct(*[_c(c).cast("double").alias(n) for c, n in zip((minx, miny, maxx, maxy), BBOX_FIELDS)])


SQL_FUNCTIONS = {
    "st_bbox": _bbox_udf,
    "st_intersects": _intersects_udf,
    "st_intersection": _intersection_udf,
    "st_clip_polygonal": _clip_udf,
    "st_area": _area_udf,
    "st_length": _length_udf,
    "st_isvalid": _is_valid_udf,
    "st_makevalid": _make_valid_udf,
    "st_multi": _multi_udf,
    "st_polygonal": _polygonal_udf,
    "st_geometrytype": _geometry_type_udf,
    "st_numgeometries": _num_geometries_udf,
    "st_npoints": _num_points_udf,
    "st_astext": _as_text_udf,
    "st_makeenvelope": _envelope_udf,
    "st_polygon": _polygon_udf,
}
