"""Overlay with a small side that goes to every task as a packed spatial index.

The small side's boxes are sorted along a Hilbert curve and packed, sixteen at a
time, into a tree of boxes (arrays, level over level).  Tasks hold it beside the
small side's rows and probe it with a whole batch of the large side at once, so
neither side is spread over cells or shuffled.  Whether the side is small is
seen while its boxes are read: rows and bytes are held against the limit before
any geometry is fetched, and beyond it the grid join takes over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import _ship
from ..functions import batch
from ..session import written
from .overlay import overlay
from .spatial_join import BBOX, _default_max_broadcast, _flatten, _L, _R, with_bbox

FANOUT = 16
_CORNERS = ("minx", "miny", "maxx", "maxy")


def hilbert(x: np.ndarray, y: np.ndarray, bits: int = 16) -> np.ndarray:
    """Place along the Hilbert curve of points in the unit square."""
    top = (1 << bits) - 1
    x, y = (np.clip(v * top, 0, top).astype(np.int64) for v in (x, y))
    place = np.zeros(len(x), np.int64)
    for k in reversed(range(bits)):
        right, upper = x >> k & 1, y >> k & 1
        place += (3 * right ^ upper) << 2 * k
        turned = upper == 0
        flip = turned & (right == 1)
        x, y = np.where(flip, top - x, x), np.where(flip, top - y, y)
        x, y = np.where(turned, y, x), np.where(turned, x, y)
    return place


class PackedBoxes:
    """A packed tree over boxes [n, 4]."""

    def __init__(self, boxes: np.ndarray):
        low, span = boxes[:, :2].min(axis=0, initial=np.inf), np.ptp(boxes, axis=0)[:2] if len(boxes) else np.ones(2)
        middle = ((boxes[:, :2] + boxes[:, 2:]) / 2 - (low if len(boxes) else 0)) / np.where(span > 0, span, 1)
        self.order = np.argsort(hilbert(middle[:, 0], middle[:, 1]), kind="stable")
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > 1:
            lower = self.levels[-1]
            first = np.arange(0, len(lower), FANOUT)
            self.levels.append(np.hstack([np.minimum.reduceat(lower[:, :2], first), np.maximum.reduceat(lower[:, 2:], first)]))

    def meeting(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``boxes``, number of an indexed box) of all pairs that meet, touching included."""
        n = len(self.levels[-1])
        query, node = np.repeat(np.arange(len(boxes)), n), np.tile(np.arange(n), len(boxes))
        for depth in reversed(range(len(self.levels))):
            own, mine = self.levels[depth][node], boxes[query]
            hit = (own[:, :2] <= mine[:, 2:]).all(axis=1) & (mine[:, :2] <= own[:, 2:]).all(axis=1)
            query, node = query[hit], node[hit]
            if depth:
                below = len(self.levels[depth - 1])
                child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                query = np.repeat(query, FANOUT)[child < below]
                node = child[child < below]
        return query, self.order[node]


def small_side(df: DataFrame, geometry: str, limit: int) -> pa.Table | None:
    """The rows of ``df`` if they have at most ``limit`` bytes, told from boxes and lengths before the rows are fetched."""
    others = [c for c in df.columns if c not in (geometry, BBOX)]
    size = F.coalesce(F.length(geometry), F.lit(0)) + sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in others), F.lit(64))
    # a row has 64 bytes and more, so beyond limit // 64 rows the answer is known
    if (df.limit(limit // 64 + 1).agg(F.sum(size)).first()[0] or 0) > limit:
        return None
    return df.toArrow().combine_chunks()


def overlay_indexed(left: DataFrame, right: DataFrame, *, left_geometry: str = "geometry", right_geometry: str = "geometry",
                    output_geometry: str = "geometry", keep_geom_type: bool = True, suffixes=("_1", "_2"), prefixes: tuple | None = None,
                    max_broadcast_bytes: int | None = None, pairs_at_once: int = 20_000, **grid) -> DataFrame:
    """``overlay`` with ``right`` as the indexed side; the same rows as the grid join, which is used if it is too large."""
    spark = left.sparkSession
    limit = _default_max_broadcast(spark) if max_broadcast_bytes is None else max_broadcast_bytes
    held = written(with_bbox(right, right_geometry).where(F.col(BBOX).isNotNull()), "overlay-small") if limit else None
    small = small_side(held, right_geometry, limit) if held is not None else None
    if small is None:
        return overlay(left, right, left_geometry=left_geometry, right_geometry=right_geometry, output_geometry=output_geometry,
                       keep_geom_type=keep_geom_type, suffixes=suffixes, prefixes=prefixes, **grid)
    _ship.ensure(spark)
    corners = small.column(BBOX).combine_chunks()
    index = PackedBoxes(np.column_stack([corners.field(k).to_numpy(zero_copy_only=False) for k in _CORNERS]) if len(small) else np.zeros((0, 4)))
    sent = spark.sparkContext.broadcast((index, small.to_batches()[0] if len(small) else None))  # at most the limit
    lcols, rcols = [c for c in left.columns if c not in (left_geometry, BBOX)], [c for c in right.columns if c not in (right_geometry, BBOX)]

    def probed(batches):
        tree, rows = sent.value
        for b in batches:
            if rows is None or not b.num_rows:
                continue
            query, item = tree.meeting(batch.bounds(b.column(left_geometry)))
            for i in range(0, len(query), pairs_at_once):
                q, r = pa.array(query[i : i + pairs_at_once]), pa.array(item[i : i + pairs_at_once])
                shared = batch.intersection_batch(b.column(left_geometry).take(q), rows.column(right_geometry).take(r), keep_geom_type, empty_as_null=True)
                sides = [pa.StructArray.from_arrays([x.column(c).take(k) for c in cols], fields=[x.schema.field(c) for c in cols])
                         for x, cols, k in ((b, lcols, q), (rows, rcols, r))]
                out = pa.RecordBatch.from_arrays([*sides, shared], names=[_L, _R, "__g"])
                yield out.filter(shared.is_valid())

    schema = T.StructType([T.StructField(_L, T.StructType([left.schema[c] for c in lcols])), T.StructField(_R, T.StructType([right.schema[c] for c in rcols])),
                           T.StructField("__g", T.BinaryType())])
    pairs = left.select(*lcols, left_geometry).mapInArrow(probed, schema)
    return pairs.select(*_flatten(pairs, lcols, rcols, suffixes, prefixes), F.col("__g").alias(output_geometry))
