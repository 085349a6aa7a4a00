"""Geometry layers derived from the driver's test tables.

The test tables carry no geometry, so layers are built from their keys with
integer arithmetic (exact in doubles), the same arithmetic the SQL oracle
uses.  All builders are Column expressions over the parquet scan; only the
WKB encoding runs as a vectorised Arrow UDF.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bbox_of, st_make_envelope, st_polygon

# Fixture constants shared with the SQL oracle.
PARCELS_PER_ROW = 100
PARCEL_SIZE = 10
BUILDING_X_MUL, BUILDING_X_MOD = 7919, 995
BUILDING_Y_MUL, BUILDING_Y_MOD = 104729, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcel_box(k):
    minx = (k % PARCELS_PER_ROW) * PARCEL_SIZE
    miny = F.floor(k / PARCELS_PER_ROW) * PARCEL_SIZE
    return minx.cast("double"), miny.cast("double"), (minx + PARCEL_SIZE).cast("double"), (miny + PARCEL_SIZE).cast("double")


def building_origin(k):
    x = ((k * BUILDING_X_MUL) % BUILDING_X_MOD).cast("double")
    y = ((k * BUILDING_Y_MUL) % BUILDING_Y_MOD).cast("double")
    return x, y


def building_box(k):
    x, y = building_origin(k)
    return x, y, x + 1 + (k % 6), y + 1 + (k % 4)


def parcels_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parcels tiling the plane, 100 per row, 10 x 10 each."""
    k = F.col("p_partkey")
    x0, y0, x1, y1 = parcel_box(k)
    return table(spark, sf_dir, "part").select(
        k.alias("parcel_oid"),
        F.col("p_type").alias("nutzart"),
        F.col("p_brand").alias("bez"),
        st_make_envelope(x0, y0, x1, y1).alias("geometry"),
        bbox_of(x0, y0, x1, y1).alias("bbox"),
    )


def buildings_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """small boxes from orders, some touching or crossing parcel edges."""
    k = F.col("o_orderkey")
    x0, y0, x1, y1 = building_box(k)
    return table(spark, sf_dir, "orders").select(
        k.alias("building_oid"),
        F.col("o_orderpriority").alias("funktion"),
        F.to_date("o_orderdate").alias("aktualit"),
        st_make_envelope(x0, y0, x1, y1).alias("geometry"),
        bbox_of(x0, y0, x1, y1).alias("bbox"),
    )


def _ring(*pts) -> F.Column:
    return F.array(*[c for p in pts for c in p])


def buildings_lshape(spark: SparkSession, sf_dir: str, hole: bool = False) -> DataFrame:
    """2 x 2 square minus its upper-right unit cell (concave).

    F3h (``hole=True``): 3 x 3 square with the middle unit cell as a hole.
    """
    k = F.col("o_orderkey")
    x, y = building_origin(k)
    if hole:
        shell = _ring((x, y), (x + 3, y), (x + 3, y + 3), (x, y + 3), (x, y))
        inner = _ring((x + 1, y + 1), (x + 1, y + 2), (x + 2, y + 2), (x + 2, y + 1), (x + 1, y + 1))
        rings = F.array(shell, inner)
        x1, y1 = x + 3, y + 3
    else:
        rings = F.array(_ring((x, y), (x + 2, y), (x + 2, y + 1), (x + 1, y + 1), (x + 1, y + 2), (x, y + 2), (x, y)))
        x1, y1 = x + 2, y + 2
    return table(spark, sf_dir, "orders").select(
        k.alias("building_oid"),
        F.col("o_orderpriority").alias("funktion"),
        st_polygon(rings).alias("geometry"),
        bbox_of(x, y, x1, y1).alias("bbox"),
    )


def buildings_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares rotated by 45 degrees, with integer corners 3 away from the middle."""
    k = F.col("o_orderkey")
    x, y = building_origin(k)
    ring = _ring((x + 3, y), (x + 6, y + 3), (x + 3, y + 6), (x, y + 3), (x + 3, y))
    return table(spark, sf_dir, "orders").select(
        k.alias("building_oid"), st_polygon(F.array(ring)).alias("geometry"), bbox_of(x, y, x + 6, y + 6).alias("bbox"))


def two_part_origin():
    k = F.col("c_custkey")
    return k, ((k * 7919) % 985).cast("double"), ((k * 104729) % 190).cast("double")


def buildings_two_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MultiPolygons of two 2 x 2 squares, 12 apart, in both part orders (odd and even keys)."""
    k, x, y = two_part_origin()

    def square(dx):
        return st_polygon(F.array(_ring((x + dx, y), (x + dx + 2, y), (x + dx + 2, y + 2), (x + dx, y + 2), (x + dx, y))))

    near, far = square(0), square(12)
    header = F.unhex(F.lit("010600000002000000"))  # little-endian MultiPolygon of two
    return table(spark, sf_dir, "customer").select(
        k.alias("building_oid"), F.when(k % 2 == 0, F.concat(header, near, far)).otherwise(F.concat(header, far, near)).alias("geometry"),
        bbox_of(x, y, x + 14, y + 2).alias("bbox"))


def parcels_enclave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parcels with a 2 x 2 hole in the middle."""
    k = F.col("p_partkey")
    x0, y0, x1, y1 = parcel_box(k)
    rings = F.array(_ring((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)),
                    _ring((x0 + 4, y0 + 4), (x0 + 4, y0 + 6), (x0 + 6, y0 + 6), (x0 + 6, y0 + 4), (x0 + 4, y0 + 4)))
    return table(spark, sf_dir, "part").select(k.alias("parcel_oid"), st_polygon(rings).alias("geometry"), bbox_of(x0, y0, x1, y1).alias("bbox"))


def buildings_over_enclave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that cover a parcel's hole and touch no edge."""
    k = F.col("c_custkey")
    x, y = ((k % 100) * 10 + 3 - k % 2).cast("double"), (F.floor(k / 100) % 2 * 10 + 2).cast("double")
    return table(spark, sf_dir, "customer").select(
        k.alias("building_oid"), st_make_envelope(x, y, x + 5, y + 5 + k % 3).alias("geometry"), bbox_of(x, y, x + 5, y + 5 + k % 3).alias("bbox"))


def buildings_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bow-ties for ``k % 7 = 0``, NULL geometry for ``k % 101 = 0``, else F2 boxes."""
    k = F.col("o_orderkey")
    x, y = building_origin(k)
    _, _, bx1, by1 = building_box(k)
    bow = F.array(_ring((x, y), (x + 2, y + 2), (x + 2, y), (x, y + 2), (x, y)))
    box = F.array(_ring((x, y), (bx1, y), (bx1, by1), (x, by1), (x, y)))
    rings = F.when(k % 101 == 0, F.lit(None)).when(k % 7 == 0, bow).otherwise(box)
    return table(spark, sf_dir, "orders").select(
        k.alias("building_oid"),
        F.col("o_orderpriority").alias("funktion"),
        st_polygon(rings).alias("geometry"),
    )


def counties(df: DataFrame, key: str, layer: str, changed_col: str | None, n_counties: int = 4,
             skip_county: int | None = None) -> DataFrame:
    """rows spread over counties; ``k % 50 = 0`` rows repeat in the next county.

    The repeated copy has ``changed_col`` altered (so keep-first is observable),
    ``source_file`` names ``c<county>/<layer>.shp`` and ``record_no`` is the key.
    """
    k = F.col(key)
    base = df.withColumn("county", (k % n_counties).cast("int"))
    dup = df.where(k % 50 == 0).withColumn("county", ((k + 1) % n_counties).cast("int"))
    if changed_col:
        dup = dup.withColumn(changed_col, F.concat(F.col(changed_col), F.lit("*")))
    both = base.unionByName(dup)
    if skip_county is not None:
        both = both.where(F.col("county") != skip_county)
    return (both.withColumn("source_file", F.concat(F.lit("c"), F.col("county").cast("string"), F.lit(f"/{layer}.shp")))
                .withColumn("record_no", k.cast("long")))


def buildings_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counties(buildings_rect(spark, sf_dir), "building_oid", "GebauedeBauwerk", "funktion")


def parcels_counties(spark: SparkSession, sf_dir: str, skip_county: int | None = 3) -> DataFrame:
    return counties(parcels_grid(spark, sf_dir), "parcel_oid", "NutzungFlurstueck", "nutzart", skip_county=skip_county)


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lon/lat from customer keys, plus a metre-based point that is out of range."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("c_custkey"),
        ((k * 37) % 360 - 180).cast("double").alias("lon"),
        ((k * 17) % 180 - 90).cast("double").alias("lat"),
    )


#: Arms of the very large L shapes (width of the plane, thickness, height).
WIDE_L = (600, 20, 190)


def wide_lshapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L shapes over hundreds of parcels, from suppliers."""
    k = F.col("s_suppkey")
    w, t, h = (F.lit(float(v)) for v in WIDE_L)
    x, y = (k * 37 % 395).cast("double"), (k * 3 % 10).cast("double")
    ring = _ring((x, y), (x + w, y), (x + w, y + t), (x + t, y + t), (x + t, y + h), (x, y + h), (x, y))
    return table(spark, sf_dir, "supplier").select(k.alias("area_oid"), st_polygon(F.array(ring)).alias("geometry"))
