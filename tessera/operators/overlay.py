"""Intersection overlay of two polygon layers.

``overlay`` = spatial join (grid equi-join, see :mod:`spatial_join`) + the
clipped shared geometry + both attribute sets.  With ``keep_geom_type`` only
polygonal results are kept (pairs that merely touch disappear); without it
touching pairs come back as lines or points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from .spatial_join import BBOX, _L, _R, _flatten, candidate_pairs


def _attr_columns(df: DataFrame, geometry: str, wanted: list | None) -> list:
    if wanted is not None:
        return list(wanted)
    return [c for c in df.columns if c not in (geometry, BBOX)]


def overlay(
    left: DataFrame,
    right: DataFrame,
    how: str = "intersection",
    *,
    keep_geom_type: bool = True,
    left_geometry: str = "geometry",
    right_geometry: str = "geometry",
    output_geometry: str = "geometry",
    left_columns: list | None = None,
    right_columns: list | None = None,
    suffixes=("_1", "_2"),
    prefixes: tuple | None = None,
    partition_by: list | None = None,
    late_attributes: tuple | None = None,
    **grid,
) -> DataFrame:
    """Every (left, right) pair whose shapes share area yields one row.

    Columns: the left attributes, the right attributes (names on both sides
    get ``suffixes``, or every column gets ``prefixes`` when given), then the
    shared geometry.  ``partition_by`` restricts pairs to equal key values
    (county-wise overlay).  ``late_attributes=(left_id, right_id)`` joins
    only ids and geometry spatially and fetches the attributes afterwards by
    id (both ids must be unique).  Remaining keywords tune the grid join.
    """
    if how != "intersection":
        raise ValueError("only how='intersection' is supported")
    partition_by = list(partition_by or [])
    lattrs = _attr_columns(left, left_geometry, left_columns)
    rattrs = _attr_columns(right, right_geometry, right_columns)
    if late_attributes:
        return _overlay_late(left, right, lattrs, rattrs, keep_geom_type=keep_geom_type,
                             left_geometry=left_geometry, right_geometry=right_geometry,
                             output_geometry=output_geometry, suffixes=suffixes, prefixes=prefixes,
                             partition_by=partition_by, ids=late_attributes, **grid)
    keepL = list(dict.fromkeys(lattrs + [left_geometry] + partition_by + ([BBOX] if BBOX in left.columns else [])))
    keepR = list(dict.fromkeys(rattrs + [right_geometry] + partition_by + ([BBOX] if BBOX in right.columns else [])))
    pairs, _ = candidate_pairs(left.select(*keepL), right.select(*keepR), left_geometry=left_geometry,
                               right_geometry=right_geometry, partition_by=partition_by, **grid)
    lg, rg = F.col(f"{_L}.{left_geometry}"), F.col(f"{_R}.{right_geometry}")
    clip = fc._clip_udf if keep_geom_type else fc._intersection_nonempty_udf
    fc._ship.ensure()
    # the kernel is marked nondeterministic so Catalyst evaluates it exactly once per pair
    shared = pairs.select("*", clip.asNondeterministic()(lg, rg).alias("__g"))
    shared = shared.where(F.col("__g").isNotNull())
    out_l = [c for c in lattrs]
    out_r = [c for c in rattrs if c not in partition_by]
    cols = _flatten(shared, out_l, out_r, suffixes, prefixes)
    extra = [F.col(f"{_L}.{k}").alias(k) for k in partition_by if k not in out_l]
    return shared.select(*cols, *extra, F.col("__g").alias(output_geometry))


def _overlay_late(left, right, lattrs, rattrs, *, keep_geom_type, left_geometry, right_geometry,
                  output_geometry, suffixes, prefixes, partition_by, ids, **grid) -> DataFrame:
    lid, rid = ids
    lk = [lid] + [k for k in partition_by if k != lid] + [left_geometry] + ([BBOX] if BBOX in left.columns else [])
    rk = [rid] + [k for k in partition_by if k != rid] + [right_geometry] + ([BBOX] if BBOX in right.columns else [])
    slim = overlay(left.select(*lk), right.select(*rk), keep_geom_type=keep_geom_type,
                   left_geometry=left_geometry, right_geometry=right_geometry, output_geometry="__g",
                   left_columns=[lid], right_columns=[rid], suffixes=("__a", "__b"),
                   partition_by=partition_by, **grid)
    lname = lid + "__a" if lid == rid else lid
    rname = rid + "__b" if lid == rid else rid
    ids_only = slim.select(F.col(lname).alias("__lid"), F.col(rname).alias("__rid"), "__g")
    la = left.select(F.struct(*[F.col(c) for c in lattrs]).alias(_L), F.col(lid).alias("__lid2"))
    ra = right.select(F.struct(*[F.col(c) for c in rattrs]).alias(_R), F.col(rid).alias("__rid2"))
    j = (ids_only.join(la, ids_only["__lid"] == la["__lid2"], "inner")
                 .join(ra, ids_only["__rid"] == ra["__rid2"], "inner"))
    out_r = [c for c in rattrs if c not in partition_by]
    return j.select(*_flatten(j, lattrs, out_r, suffixes, prefixes), F.col("__g").alias(output_geometry))
