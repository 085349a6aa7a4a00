"""Geometry repair and promotion on whole layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import st_is_valid, st_multi
from ..functions.columns import make_valid_once


def repair(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Replace every invalid geometry by a valid one; NULL stays NULL.

    ``st_make_valid`` checks validity itself and returns valid input byte for
    byte, so repairing all rows and repairing only the invalid ones is one and
    the same pass.  It is marked non-deterministic here, so that Catalyst does
    not copy it into every later use of the column.
    """
    return df.withColumn(geometry, make_valid_once(F.col(geometry)))


def invalid_rows(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Rows whose geometry is not valid (``WHERE NOT ST_IsValid(geom)``)."""
    return df.where(~st_is_valid(F.col(geometry)))


def promote_to_multi(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Polygon rows become one-part MultiPolygons (``PROMOTE_TO_MULTI``)."""
    return df.withColumn(geometry, st_multi(F.col(geometry)))
