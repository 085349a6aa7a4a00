"""Overlay of layers with very large features: cut along a grid, clipped per piece, put together per pair.

A feature that covers many cells would travel to each of them whole.  Here it is
cut first, in the task that reads it: into strips along x, each strip into cells
along y, so every part of its outline is clipped a few times and only pieces
(its own bytes plus the cuts) are shuffled, without attributes.  The grid join
then sees features of one size.  Pairs of whole features are finished; the
pieces of a pair are united into one geometry by an aggregate per pair, and
attributes come back by row number.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .. import _ship
from ..functions import st_bbox, st_make_envelope, wkb
from ..functions import columns as fc
from ..functions import geometry as g
from ..session import written
from .overlay import overlay
from .spatial_join import BBOX, _L, _R, _flatten, choose_cell_size, with_bbox


def _snapped(shapes: list, share: float = 1e-12) -> list:
    """The pieces with coordinates that differ by rounding alone made equal: both sides of a cut compute its ends."""
    rings = [r for polygons in shapes for p in polygons for r in p]
    points = np.vstack(rings)
    for axis in (0, 1):
        order = np.argsort(points[:, axis], kind="stable")
        v = points[order, axis]
        first = np.flatnonzero(np.r_[True, np.diff(v) > share * max(1.0, np.abs(points).max())])
        points[order, axis] = np.repeat(v[first], np.diff(np.r_[first, len(v)]))
    parts = iter(np.split(points, np.cumsum([len(r) for r in rings])[:-1]))
    return [[[g.clean_ring(next(parts)) for _ in p] for p in polygons] for polygons in shapes]


def _split_on_cuts(edges: np.ndarray) -> np.ndarray:
    """Edges along the axes, split at every corner that lies on them."""
    corners = np.unique(np.vstack([edges[:, :2], edges[:, 2:]]), axis=0)
    for axis in (0, 1):
        other = 1 - axis
        on_line = edges[:, axis] == edges[:, axis + 2]
        order = np.lexsort((corners[:, other], corners[:, axis]))
        line, along = corners[order, axis], corners[order, other]
        out = [edges[~on_line]]
        for e in edges[on_line]:
            first, last = np.searchsorted(line, e[axis], "left"), np.searchsorted(line, e[axis], "right")
            low, high = sorted((e[other], e[other + 2]))
            stops = along[first:last]
            stops = stops[(stops >= low) & (stops <= high)]
            if e[other] > e[other + 2]:
                stops = stops[::-1]
            parts = np.empty((len(stops) - 1, 4))
            parts[:, [axis, axis + 2]] = e[axis]
            parts[:, other], parts[:, other + 2] = stops[:-1], stops[1:]
            out.append(parts)
        edges = np.vstack(out)
    return edges


@F.arrow_udf(BinaryType())
def _united(pieces: pa.Array) -> pa.Array:
    """One geometry of the pieces of each list.  Pieces meet along cuts alone: there their edges run both ways and go."""
    out = []
    for row in pieces:
        shapes = _snapped([wkb.parse(x.as_py()).polygons for x in row.values])
        edges = _split_on_cuts(g.edges_of(g.oriented([p for polygons in shapes for p in polygons])))
        there = Counter(map(tuple, edges.tolist()))
        left = [e for e in there for _ in range(there[e] - there.get((e[2], e[3], e[0], e[1]), 0))]
        rings = g._stitch(np.array(left).reshape(-1, 4))
        out.append(wkb.encode(wkb.Shape(polygons=g._assemble(rings, g.REL_TOL * g._scale(edges)))))
    return pa.array(out, pa.binary())


def _clipped(geometry: str, size: float, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return _on_cuts(fc._clip_udf.asNondeterministic()(F.col(geometry), st_make_envelope(x0, y0, x1, y1)), F.lit(size))


@F.arrow_udf(BinaryType())
def _on_cuts(pieces: pa.Array, size: pa.Array) -> pa.Array:
    """Corners that lie on a cut but for rounding, put on it: pieces of two layers then have equal borders there."""
    step = size[0].as_py() if len(size) else 1.0
    out = []
    for piece in pieces:
        shape = wkb.parse(piece.as_py()) if piece.is_valid else None
        for r in (r for p in shape.polygons for r in p) if shape else ():
            cut = np.round(r / step) * step
            np.copyto(r, cut, where=np.abs(r - cut) <= 1e-12 * np.maximum(step, np.abs(r)))
        out.append(None if shape is None else wkb.encode(wkb.Shape(polygons=[[g.clean_ring(r) for r in p] for p in shape.polygons])))
    return pa.array(out, pa.binary())


def subdivide(df: DataFrame, id_col: str, size: float, geometry: str = "geometry", most_cells: int = 4) -> DataFrame:
    """(id, geometry, bbox, cut): features over more than ``most_cells`` cells of ``size`` in pieces, the others whole."""
    _ship.ensure()
    df = with_bbox(df, geometry).select(id_col, F.col(geometry).alias("geometry"), BBOX).where(F.col(BBOX).isNotNull())
    cell = lambda corner: F.floor(F.col(f"{BBOX}.{corner}") / F.lit(size))
    at = lambda k: F.col(k) * F.lit(size)
    wide = (cell("maxx") - cell("minx") + 1) * (cell("maxy") - cell("miny") + 1) > most_cells
    strips = df.where(wide).withColumn("k", F.explode(F.sequence(cell("minx"), cell("maxx"))))
    strips = strips.select(id_col, _clipped("geometry", size, at("k"), F.col("bbox.miny"), at("k") + size, F.col("bbox.maxy")).alias("geometry"))
    strips = strips.where("geometry IS NOT NULL").withColumn(BBOX, st_bbox("geometry"))
    cells = strips.withColumn("k", F.explode(F.sequence(cell("miny"), cell("maxy"))))
    cells = cells.select(id_col, _clipped("geometry", size, F.col("bbox.minx"), at("k"), F.col("bbox.maxx"), at("k") + size).alias("geometry"))
    cells = cells.where("geometry IS NOT NULL").withColumn(BBOX, st_bbox("geometry"))
    return df.where(~wide).withColumn("cut", F.lit(False)).unionByName(cells.withColumn("cut", F.lit(True)))


def overlay_subdivided(left: DataFrame, right: DataFrame, *, left_geometry: str = "geometry", right_geometry: str = "geometry",
                       output_geometry: str = "geometry", suffixes=("_1", "_2"), prefixes: tuple | None = None,
                       piece_size: float | None = None, **grid) -> DataFrame:
    """``overlay`` (polygonal parts) for layers of which some features cover very many cells.

    ``piece_size``: side of a piece; by default four of the grid join's cells.
    """
    # a row's number is made once, as the table is written
    sides = [written(with_bbox(df, geometry).withColumn("row_of_side", F.monotonically_increasing_id()), "overlay-side")
             for df, geometry in ((left, left_geometry), (right, right_geometry))]
    size = piece_size or 4 * choose_cell_size(*sides, left_geometry, right_geometry)
    pieces = [written(subdivide(df, "row_of_side", size, geometry), "overlay-pieces")
              for df, geometry in zip(sides, (left_geometry, right_geometry), strict=True)]
    pairs = written(overlay(*pieces, suffixes=("_l", "_r"), **grid), "overlay-pairs")
    of_cut = F.col("cut_l") | F.col("cut_r")
    ids = ["row_of_side_l", "row_of_side_r"]
    parts = pairs.where(of_cut).groupBy(*ids).agg(F.collect_list("geometry").alias("parts"))
    parts = parts.select(*ids, F.when(F.size("parts") == 1, F.col("parts")[0]).otherwise(_united("parts")).alias("__g"))
    shared = pairs.where(~of_cut).select(*ids, F.col("geometry").alias("__g")).unionByName(parts)
    columns = [[c for c in df.columns if c not in (geometry, BBOX)] for df, geometry in ((left, left_geometry), (right, right_geometry))]
    for df, cols, name, row in zip(sides, columns, (_L, _R), ids, strict=True):
        attributes = df.select(F.struct(*[F.col(c) for c in cols]).alias(name), F.col("row_of_side").alias(row))
        shared = shared.join(attributes, row)
    return shared.select(*_flatten(shared, *columns, suffixes, prefixes), F.col("__g").alias(output_geometry))

