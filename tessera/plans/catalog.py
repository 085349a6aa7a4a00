"""Registered queries (one per operator) and their SQL oracles.

Each query reads the driver's test tables, builds geometry layers from them
(:mod:`fixtures`) and runs one operator over the whole tables.  Results
carry comparable numbers (ids, areas, types, hashes), never WKB bytes, so
plain SQL on the same tables can check them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    geohash,
    geohash_sql,
    grid_hash,
    st_area,
    st_bbox,
    st_geohash,
    st_geometry_type,
    st_grid_hash,
    st_intersection,
    st_is_valid,
    st_length,
    st_num_geometries,
    st_polygonal,
)
from ..operators.dedup import concat_layers, drop_duplicates_any, drop_duplicates_first, insert_if_absent
from ..operators.overlay import overlay
from ..operators.repair import invalid_rows, promote_to_multi, repair
from ..operators.spatial_join import spatial_join, spatial_join_sql
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ----------------------------------------------------------- SQL fixtures

B_RECT = """SELECT o_orderkey AS building_oid, o_orderpriority AS funktion,
       CAST(o_orderdate AS DATE) AS aktualit,
       CAST((o_orderkey * 7919) % 995 AS DOUBLE) AS minx,
       CAST((o_orderkey * 104729) % 200 AS DOUBLE) AS miny,
       CAST((o_orderkey * 7919) % 995 + 1 + o_orderkey % 6 AS DOUBLE) AS maxx,
       CAST((o_orderkey * 104729) % 200 + 1 + o_orderkey % 4 AS DOUBLE) AS maxy
FROM orders"""

P_GRID = """SELECT p_partkey AS parcel_oid, p_type AS nutzart, p_brand AS bez,
       DATE '2020-01-01' + p_size AS aktualit,
       CAST((p_partkey % 100) * 10 AS DOUBLE) AS minx,
       CAST((p_partkey // 100) * 10 AS DOUBLE) AS miny,
       CAST((p_partkey % 100) * 10 + 10 AS DOUBLE) AS maxx,
       CAST((p_partkey // 100) * 10 + 10 AS DOUBLE) AS maxy
FROM part"""

STRICT = "b.minx < p.maxx AND p.minx < b.maxx AND b.miny < p.maxy AND p.miny < b.maxy"
CLOSED = "b.minx <= p.maxx AND p.minx <= b.maxx AND b.miny <= p.maxy AND p.miny <= b.maxy"
W = "(LEAST(b.maxx, p.maxx) - GREATEST(b.minx, p.minx))"
H = "(LEAST(b.maxy, p.maxy) - GREATEST(b.miny, p.miny))"


def _counties_sql(base: str, key: str, layer: str, changed: str, skip: int | None = None) -> str:
    cols_dup = f"* REPLACE ({changed} || '*' AS {changed})"
    where = f"WHERE county <> {skip}" if skip is not None else ""
    return f"""SELECT *, 'c' || CAST(county AS VARCHAR) || '/{layer}.shp' AS source_file,
       CAST({key} AS BIGINT) AS record_no
FROM (
  SELECT *, CAST({key} % 4 AS INTEGER) AS county FROM ({base}) x
  UNION ALL
  SELECT {cols_dup}, CAST(({key} + 1) % 4 AS INTEGER) AS county FROM ({base}) y WHERE {key} % 50 = 0
) u {where}"""


B_COUNTIES = _counties_sql(B_RECT, "building_oid", "GebauedeBauwerk", "funktion")
P_COUNTIES = _counties_sql(P_GRID, "parcel_oid", "NutzungFlurstueck", "nutzart", skip=3)


def _cells_sql(cells: list) -> str:
    """Clipped area of shapes made of unit cells (dx, dy) or, with a share, of parts of such cells."""
    values = ", ".join(f"({dx}, {dy}, {share[0] if share else 1})" for dx, dy, *share in cells)
    return f"""WITH b AS (SELECT o_orderkey AS building_oid,
                  CAST((o_orderkey * 7919) % 995 AS DOUBLE) AS x,
                  CAST((o_orderkey * 104729) % 200 AS DOUBLE) AS y FROM orders),
c AS (SELECT building_oid, x + dx AS cx, y + dy AS cy, share FROM b, (VALUES {values}) AS d(dx, dy, share)),
p AS (SELECT p_partkey AS parcel_oid FROM part)
SELECT c.building_oid, p.parcel_oid, CAST(SUM(share) AS DOUBLE) AS area
FROM c JOIN p ON p.parcel_oid = CAST(FLOOR(c.cy / 10) * 100 + FLOOR(c.cx / 10) AS BIGINT)
GROUP BY c.building_oid, p.parcel_oid"""


L_CELLS = [(0, 0), (1, 0), (0, 1)]
#: Cells of a square rotated by 45 degrees about (3, 3): whole ones, and halves along its sides.
R_CELLS = [(dx, dy, 1 if u + v < 2 else 0.5) for dx in range(6) for dy in range(6)
           for u, v in [(max(dx - 3, 2 - dx), max(dy - 3, 2 - dy))] if u + v <= 2]
H_CELLS = [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1), (0, 2), (1, 2), (2, 2)]

OVERLAY_SQL = f"""WITH b AS ({B_RECT}), p AS ({P_GRID})
SELECT b.building_oid, b.funktion, b.aktualit, p.parcel_oid, p.nutzart, p.bez, {W} * {H} AS area
FROM b JOIN p ON {STRICT}"""


# ---------------------------------------------------------- Spark helpers

def _layers(spark, sf_dir):
    return fx.buildings_rect(spark, sf_dir), fx.parcels_grid(spark, sf_dir)


def _overlay_out(df: DataFrame) -> DataFrame:
    return df.select("building_oid", "funktion", "aktualit", "parcel_oid", "nutzart", "bez",
                     st_area("geometry").alias("area"))


# ------------------------------------------------------------------ joins

@query("overlay_intersection", OVERLAY_SQL)
def overlay_intersection(spark, sf_dir):
    """Intersection overlay, polygonal results only, both attribute sets."""
    b, p = _layers(spark, sf_dir)
    return _overlay_out(overlay(b, p))


@query("overlay_broadcast", OVERLAY_SQL)
def overlay_broadcast(spark, sf_dir):
    """Parcels broadcast to every building partition (after a size check)."""
    b, p = _layers(spark, sf_dir)
    return _overlay_out(overlay(b, p, broadcast="right"))


@query("overlay_late_attributes", OVERLAY_SQL)
def overlay_late_attributes(spark, sf_dir):
    """Spatial join on ids and geometry only, attributes joined back by id."""
    b, p = _layers(spark, sf_dir)
    return _overlay_out(overlay(b, p, late_attributes=("building_oid", "parcel_oid")))


@query("overlay_salted", OVERLAY_SQL)
def overlay_salted(spark, sf_dir):
    """Skew path: every cell above 50 rows is split into salt buckets."""
    b, p = _layers(spark, sf_dir)
    return _overlay_out(overlay(b, p, hot_cell_rows=50))


@query("overlay_touching_kept", f"""WITH b AS ({B_RECT}), p AS ({P_GRID})
SELECT b.building_oid, p.parcel_oid,
       CASE WHEN {W} > 0 AND {H} > 0 THEN 'Polygon' WHEN {W} > 0 OR {H} > 0 THEN 'LineString' ELSE 'Point' END AS geom_type,
       CASE WHEN {W} > 0 AND {H} > 0 THEN {W} * {H} ELSE 0.0 END AS area,
       CASE WHEN {W} > 0 AND {H} > 0 THEN 0.0 ELSE {W} + {H} END AS length
FROM b JOIN p ON {CLOSED}""")
def overlay_touching_kept(spark, sf_dir):
    """J4 with keep_geom_type=False: touching pairs come back as lines and points."""
    b, p = _layers(spark, sf_dir)
    o = overlay(b, p, keep_geom_type=False)
    return o.select("building_oid", "parcel_oid", st_geometry_type("geometry").alias("geom_type"),
                    st_area("geometry").alias("area"), st_length("geometry").alias("length"))


@query("overlay_lshapes", _cells_sql(L_CELLS))
def overlay_lshapes(spark, sf_dir):
    """J3 on concave buildings: clipped area counted in unit cells."""
    o = overlay(fx.buildings_lshape(spark, sf_dir), fx.parcels_grid(spark, sf_dir))
    return o.select("building_oid", "parcel_oid", st_area("geometry").alias("area"))


@query("overlay_rotated", _cells_sql(R_CELLS))
def overlay_rotated(spark, sf_dir):
    """J3 on rotated buildings: clipped area counted in unit cells and halves of them."""
    o = overlay(fx.buildings_rotated(spark, sf_dir), fx.parcels_grid(spark, sf_dir))
    return o.select("building_oid", "parcel_oid", st_area("geometry").alias("area"))


@query("overlay_holes", _cells_sql(H_CELLS))
def overlay_holes(spark, sf_dir):
    """J3 on buildings with a hole."""
    o = overlay(fx.buildings_lshape(spark, sf_dir, hole=True), fx.parcels_grid(spark, sf_dir))
    return o.select("building_oid", "parcel_oid", st_area("geometry").alias("area"))


@query("spatial_join_intersects", f"""WITH b AS ({B_RECT}), p AS ({P_GRID})
SELECT b.building_oid, p.parcel_oid FROM b JOIN p ON {CLOSED}""")
def spatial_join_intersects(spark, sf_dir):
    """ST_Intersects join, boundary contact included."""
    b, p = _layers(spark, sf_dir)
    return spatial_join(b, p).select("building_oid", "parcel_oid")


@query("spatial_join_sql", f"""WITH b AS ({B_RECT}), p AS ({P_GRID})
SELECT b.building_oid, p.parcel_oid, {W} * {H} AS area FROM b JOIN p ON {STRICT}""")
def spatial_join_sql_form(spark, sf_dir):
    """The same join written in SQL over temp views (K8), clip in SQL."""
    from ..session import register

    register(spark)
    b, p = _layers(spark, sf_dir)
    b.createOrReplaceTempView("tessera_buildings")
    p.createOrReplaceTempView("tessera_usage")
    return spatial_join_sql(spark, "tessera_buildings", "tessera_usage", "a.building_oid, b.parcel_oid, st_area(shared) AS area", clip="shared")


@query("overlay_county_wise", f"""WITH b AS ({B_COUNTIES}), p AS ({P_COUNTIES})
SELECT b.county, b.building_oid, p.parcel_oid, b.funktion, p.nutzart, {W} * {H} AS area
FROM b JOIN p ON b.county = p.county AND {STRICT}""")
def overlay_county_wise(spark, sf_dir):
    """Overlay only within one county (no dedup; border copies kept)."""
    b = fx.buildings_counties(spark, sf_dir).select("building_oid", "funktion", "county", "geometry", "bbox")
    p = fx.parcels_counties(spark, sf_dir).select("parcel_oid", "nutzart", "county", "geometry", "bbox")
    o = overlay(b, p, partition_by=["county"])
    return o.select("county", "building_oid", "parcel_oid", "funktion", "nutzart", st_area("geometry").alias("area"))


@query("overlay_suffixes", f"""WITH b AS ({B_RECT}), p AS ({P_GRID})
SELECT b.building_oid AS oid_1, b.aktualit AS aktualit_1, b.funktion,
       p.parcel_oid AS oid_2, p.aktualit AS aktualit_2, p.nutzart, {W} * {H} AS area
FROM b JOIN p ON {STRICT}""")
def overlay_suffixes(spark, sf_dir):
    """P5: shared column names (oid, aktualit) get _1 / _2."""
    b, p = _layers(spark, sf_dir)
    left = b.select(F.col("building_oid").alias("oid"), "aktualit", "funktion", "geometry", "bbox")
    parts = fx.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    right = (p.join(parts, p.parcel_oid == parts.p_partkey)
              .select(F.col("parcel_oid").alias("oid"),
                      F.date_add(F.to_date(F.lit("2020-01-01")), F.col("p_size")).alias("aktualit"),
                      "nutzart", "geometry", "bbox"))
    o = overlay(left, right)
    return o.select("oid_1", "aktualit_1", "funktion", "oid_2", "aktualit_2", "nutzart",
                    st_area("geometry").alias("area"))


@query("overlay_prefixes", f"""WITH b AS ({B_RECT}), p AS ({P_GRID})
SELECT b.building_oid AS l1_oid, b.funktion AS l1_funktion, p.parcel_oid AS l2_oid, p.bez AS l2_bez,
       {W} * {H} AS area
FROM b JOIN p ON {STRICT}""")
def overlay_prefixes(spark, sf_dir):
    """Per-side column lists with prefixes (file-to-file style)."""
    b, p = _layers(spark, sf_dir)
    left = b.withColumnRenamed("building_oid", "oid")
    right = p.withColumnRenamed("parcel_oid", "oid")
    o = overlay(left, right, left_columns=["oid", "funktion"], right_columns=["oid", "bez"],
                prefixes=("l1_", "l2_"))
    return o.select("l1_oid", "l1_funktion", "l2_oid", "l2_bez", st_area("geometry").alias("area"))


@query("keep_polygonal", f"""WITH b AS ({B_RECT}), p AS ({P_GRID})
SELECT b.building_oid, p.parcel_oid, {W} * {H} AS area FROM b JOIN p ON {STRICT}""")
def keep_polygonal(spark, sf_dir):
    """G4 + G5: full intersection of joined pairs, then only polygonal parts."""
    b, p = _layers(spark, sf_dir)
    j = spatial_join(b, p)
    poly = st_polygonal(st_intersection("geometry_1", "geometry_2"))
    return (j.select("building_oid", "parcel_oid", poly.alias("g")).where(F.col("g").isNotNull())
             .select("building_oid", "parcel_oid", st_area("g").alias("area")))


# ------------------------------------------------------ dedup and merging

@query("dedup_keep_first", f"""SELECT building_oid, funktion, county FROM (
  SELECT *, row_number() OVER (PARTITION BY building_oid ORDER BY source_file, record_no) AS rn
  FROM ({B_COUNTIES}) x) y WHERE rn = 1""")
def dedup_keep_first(spark, sf_dir):
    """First row per oid in (file, record) order."""
    df = fx.buildings_counties(spark, sf_dir).select("building_oid", "funktion", "county", "source_file", "record_no")
    return drop_duplicates_first(df, "building_oid").select("building_oid", "funktion", "county")


@query("dedup_any", f"SELECT DISTINCT building_oid FROM ({B_COUNTIES}) x")
def dedup_any(spark, sf_dir):
    """dropDuplicates on oid, any row wins (keys compared only)."""
    df = fx.buildings_counties(spark, sf_dir).select("building_oid", "funktion", "county")
    return drop_duplicates_any(df, "building_oid").select("building_oid")


_TARGET = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0"
_INCOMING = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0"


@query("insert_if_absent", f"""SELECT * FROM ({_TARGET}) t UNION ALL
SELECT * FROM ({_INCOMING}) i WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_TARGET}) t2)""")
def insert_if_absent_q(spark, sf_dir):
    """Append incoming rows whose key is not yet in the target."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    target = o.where(F.col("o_orderkey") % 3 == 0)
    incoming = o.where(F.col("o_orderkey") % 2 == 0)
    return insert_if_absent(target, incoming, "o_orderkey")


_TARGET_NULL = (f"{_TARGET} UNION ALL SELECT CAST(NULL AS BIGINT) AS o_orderkey, o_orderpriority "
                "FROM orders WHERE o_orderkey = 1")


@query("insert_if_absent_null", f"""SELECT * FROM ({_TARGET_NULL}) t UNION ALL
SELECT * FROM ({_INCOMING}) i WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_TARGET_NULL}) t2)""")
def insert_if_absent_null(spark, sf_dir):
    """D3 with a NULL key in the target: SQL NOT IN admits nothing."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    target = o.where(F.col("o_orderkey") % 3 == 0).unionByName(
        o.where(F.col("o_orderkey") == 1).select(F.lit(None).cast("long").alias("o_orderkey"), "o_orderpriority"))
    incoming = o.where(F.col("o_orderkey") % 2 == 0)
    return insert_if_absent(target, incoming, "o_orderkey")


@query("concat_files", f"SELECT building_oid, funktion, county, source_file FROM ({B_COUNTIES}) x")
def concat_files(spark, sf_dir):
    """Per-county layers concatenated (UNION ALL by name)."""
    df = fx.buildings_counties(spark, sf_dir).select("building_oid", "funktion", "county", "source_file")
    frames = [df.where(F.col("county") == c) for c in range(4)]
    return concat_layers(frames)


# ------------------------------------------------------- validity, repair

_F5 = """SELECT o_orderkey AS building_oid, o_orderkey % 7 = 0 AS bow, o_orderkey % 101 = 0 AS nullgeom,
       CAST((1 + o_orderkey % 6) * (1 + o_orderkey % 4) AS DOUBLE) AS box_area FROM orders"""


@query("filter_invalid", f"SELECT building_oid FROM ({_F5}) f WHERE bow AND NOT nullgeom")
def filter_invalid(spark, sf_dir):
    """Rows with NOT ST_IsValid(geometry); NULL geometry is not selected."""
    return invalid_rows(fx.buildings_invalid(spark, sf_dir)).select("building_oid")


_REPAIRED = f"""SELECT building_oid,
       CASE WHEN nullgeom THEN NULL WHEN bow THEN 2.0 ELSE box_area END AS area,
       CASE WHEN nullgeom THEN NULL ELSE TRUE END AS valid,
       CASE WHEN nullgeom THEN NULL WHEN bow THEN 'MultiPolygon' ELSE 'Polygon' END AS geom_type
FROM ({_F5}) f"""


@query("repair_invalid", _REPAIRED)
def repair_invalid(spark, sf_dir):
    """Repair only invalid rows; a bow-tie becomes two triangles of area 2."""
    df = repair(fx.buildings_invalid(spark, sf_dir))
    return df.select("building_oid", st_area("geometry").alias("area"), st_is_valid("geometry").alias("valid"),
                     st_geometry_type("geometry").alias("geom_type"))


@query("repair_all", _REPAIRED)
def repair_all(spark, sf_dir):
    """G2 on every row (the Spark variant's form)."""
    df = repair(fx.buildings_invalid(spark, sf_dir))
    return df.select("building_oid", st_area("geometry").alias("area"), st_is_valid("geometry").alias("valid"),
                     st_geometry_type("geometry").alias("geom_type"))


@query("view_after_repair", f"""WITH b AS ({B_RECT}), p AS ({P_GRID})
SELECT b.building_oid, p.parcel_oid, b.funktion, p.nutzart, {W} * {H} AS area
FROM b JOIN p ON {STRICT}""")
def view_after_repair(spark, sf_dir):
    """Id-only result repaired, then a SQL view re-joins attributes by id."""
    from ..session import register

    register(spark)
    b, p = _layers(spark, sf_dir)
    ids = overlay(b.select("building_oid", "geometry", "bbox"), p.select("parcel_oid", "geometry", "bbox"))
    for v in ("tessera_intersection", "tessera_bs", "tessera_ps"):
        spark.sql(f"DROP VIEW IF EXISTS {v}")  # K6
    repair(ids).createOrReplaceTempView("tessera_intersection")
    b.drop("geometry", "bbox").createOrReplaceTempView("tessera_bs")
    p.drop("geometry", "bbox").createOrReplaceTempView("tessera_ps")
    return spark.sql("""
        SELECT bi.building_oid, bi.parcel_oid, bs.funktion, ps.nutzart, st_area(bi.geometry) AS area
        FROM tessera_intersection bi
        JOIN tessera_bs bs ON bi.building_oid = bs.building_oid
        JOIN tessera_ps ps ON bi.parcel_oid = ps.parcel_oid""")


@query("promote_multi", f"""SELECT building_oid, 'MultiPolygon' AS geom_type, 1 AS parts,
       (maxx - minx) * (maxy - miny) AS area FROM ({B_RECT}) b""")
def promote_multi(spark, sf_dir):
    """Polygon promoted to one-part MultiPolygon."""
    df = promote_to_multi(fx.buildings_rect(spark, sf_dir))
    return df.select("building_oid", st_geometry_type("geometry").alias("geom_type"),
                     st_num_geometries("geometry").alias("parts"), st_area("geometry").alias("area"))


# ------------------------------------------------------------ hash, sort

_F6 = """SELECT c_custkey, CAST((c_custkey * 37) % 360 - 180 AS DOUBLE) AS lon,
       CAST((c_custkey * 17) % 180 - 90 AS DOUBLE) AS lat FROM customer"""


@query("geohash5", f"""SELECT c_custkey, {geohash_sql('lon', 'lat', 5)} AS geom_hash,
       {geohash_sql('lon + 300000', 'lat', 5)} AS geom_hash_metres FROM ({_F6}) c""")
def geohash5(spark, sf_dir):
    """5-character geohash; NULL outside lon/lat range (metre input)."""
    c = fx.customer_points(spark, sf_dir)
    return c.select("c_custkey", geohash("lon", "lat", 5).alias("geom_hash"),
                    geohash(F.col("lon") + 300000, "lat", 5).alias("geom_hash_metres"))


def grid_hash_sql(x: str, y: str, cell: float, bits: int = 20) -> str:
    xi = f"(CAST(FLOOR(({x}) / {float(cell)}) AS BIGINT) % {1 << bits} + {1 << bits}) % {1 << bits}"
    yi = f"(CAST(FLOOR(({y}) / {float(cell)}) AS BIGINT) % {1 << bits} + {1 << bits}) % {1 << bits}"
    terms = []
    for i in range(bits):
        terms.append(f"(((({xi}) >> {i}) & 1) << {2 * i})")
        terms.append(f"(((({yi}) >> {i}) & 1) << {2 * i + 1})")
    return "(" + " | ".join(terms) + ")"


_CX = "((GREATEST(b.minx, p.minx) + LEAST(b.maxx, p.maxx)) / 2)"
_CY = "((GREATEST(b.miny, p.miny) + LEAST(b.maxy, p.maxy)) / 2)"


@query("sort_by_hash", f"""WITH b AS ({B_RECT}), p AS ({P_GRID})
SELECT b.building_oid, p.parcel_oid, {geohash_sql(_CX, _CY, 5)} AS geom_hash,
       {grid_hash_sql(_CX, _CY, 50.0)} AS grid_hash
FROM b JOIN p ON {STRICT}""")
def sort_by_hash(spark, sf_dir):
    """G6 + O1: overlay result hashed by location and globally sorted, in ranges of the buildings' location keys."""
    from .job import location_ordered

    b, p = _layers(spark, sf_dir)
    o = overlay(b, p).withColumn("__bb", st_bbox("geometry"))
    cx = (F.col("__bb.minx") + F.col("__bb.maxx")) / 2
    cy = (F.col("__bb.miny") + F.col("__bb.maxy")) / 2
    keys = b.select(st_geohash("bbox", 5).alias("geom_hash"), st_grid_hash("bbox", 50.0).alias("grid_hash"))
    return location_ordered(o.select("building_oid", "parcel_oid", geohash(cx, cy, 5).alias("geom_hash"), grid_hash(cx, cy, 50.0).alias("grid_hash")),
                            sample=keys)


# ------------------------------------------------------------ whole job

def _dedup_first_sql(base: str, key: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY source_file, record_no) AS rn
  FROM ({base}) x) y WHERE rn = 1"""


P_ALL = _counties_sql(P_GRID, "parcel_oid", "NutzungFlurstueck", "nutzart")
JOB_SQL = f"""WITH b AS ({_dedup_first_sql(B_COUNTIES, 'building_oid')}),
p AS ({_dedup_first_sql(P_ALL, 'parcel_oid')})
SELECT b.building_oid, b.funktion, p.parcel_oid, p.nutzart, {W} * {H} AS area,
       {geohash_sql(_CX, _CY, 5)} AS geom_hash, {grid_hash_sql(_CX, _CY, 1000.0)} AS grid_hash
FROM b JOIN p ON {STRICT}"""


@query("overlay_job", JOB_SQL)
def overlay_job(spark, sf_dir):
    """The reference job on county layers: keep-first dedup, repair, overlay, location keys, global sort."""
    from .job import LOCATION_CELL, location_ordered, prepare, with_location_keys, written

    b = written(prepare(fx.buildings_counties(spark, sf_dir).withColumnRenamed("building_oid", "oid"),
                ["oid", "funktion"], "first", "all"), "buildings")
    p = written(prepare(fx.parcels_counties(spark, sf_dir, None).withColumnRenamed("parcel_oid", "oid"),
                ["oid", "nutzart"], "first", "all"), "parcels")
    o = overlay(b.withColumnRenamed("oid", "building_oid"), p.withColumnRenamed("oid", "parcel_oid"))
    keys = b.select(st_geohash("bbox", 5).alias("geom_hash"), st_grid_hash("bbox", LOCATION_CELL).alias("grid_hash"))
    o = location_ordered(with_location_keys(o), sample=keys)
    return o.select("building_oid", "funktion", "parcel_oid", "nutzart", st_area("geometry").alias("area"),
                    "geom_hash", "grid_hash")


# ----------------------------------------------------------- file formats

_WRITTEN: dict = {}


def county_shapefiles(spark, sf_dir) -> str:
    """Write F4 as per-county shapefiles once per session and data folder; returns the root."""
    from ..session import register, scratch_dir
    from .job import BUILDINGS_LAYER, PARCELS_LAYER

    register(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _WRITTEN:
        return _WRITTEN[key]
    root = scratch_dir(spark, "shapefiles")
    b = fx.buildings_counties(spark, sf_dir).select(
        F.col("building_oid").alias("oid"), "aktualit", "funktion", "county", "geometry")
    p = fx.parcels_counties(spark, sf_dir).select(
        F.col("parcel_oid").alias("oid"), "nutzart", "bez", "county", "geometry")
    for df, layer in ((b, BUILDINGS_LAYER), (p, PARCELS_LAYER)):
        (df.repartition("county").write.format("shp").mode("overwrite")
           .option("layer", layer).option("partitionBy", "county").save(root))
    _WRITTEN[key] = root
    return root


def _read_shp(spark, root, layer, columns=None, paired=None, geometry=True):
    from .job import read_layer

    return read_layer(spark, f"{root}/*/{layer}.shp", columns, paired_with=paired and f"{root}/*/{paired}.shp", geometry=geometry)


@query("shapefile_roundtrip", f"""SELECT building_oid, funktion, aktualit, county,
       (maxx - minx) * (maxy - miny) AS area FROM ({B_COUNTIES}) b""")
def shapefile_roundtrip(spark, sf_dir):
    """Write county shapefiles, read them back as one layer (record-range splits)."""
    root = county_shapefiles(spark, sf_dir)
    df = _read_shp(spark, root, "GebauedeBauwerk")
    return df.select(F.col("oid").alias("building_oid"), "funktion", "aktualit",
                     F.col("county").cast("int").alias("county"), st_area("geometry").alias("area"))


@query("shapefile_columns", f"SELECT building_oid, county FROM ({B_COUNTIES}) b")
def shapefile_columns(spark, sf_dir):
    """S3: scan with a column list (unlisted DBF fields are not decoded)."""
    root = county_shapefiles(spark, sf_dir)
    df = _read_shp(spark, root, "GebauedeBauwerk", ["oid"], geometry=False)
    return df.select(F.col("oid").alias("building_oid"), F.col("county").cast("int").alias("county"))


@query("shapefile_pushdown", f"""SELECT building_oid, funktion, county, (maxx - minx) * (maxy - miny) AS area FROM ({B_COUNTIES}) b
WHERE county IN (1, 2) AND minx < 500 AND maxy >= 100""")
def shapefile_pushdown(spark, sf_dir):
    """Filters reach the scan: other counties' files are not opened, records off the box not decoded."""
    root = county_shapefiles(spark, sf_dir)
    df = _read_shp(spark, root, "GebauedeBauwerk", ["oid", "funktion"])
    df = df.where(F.col("county").isin("1", "2") & (F.col("bbox.minx") < 500) & (F.col("bbox.maxy") >= 100))
    return df.select(F.col("oid").alias("building_oid"), "funktion", F.col("county").cast("int").alias("county"), st_area("geometry").alias("area"))


@query("shapefile_counties_paired", f"""SELECT building_oid, county FROM ({B_COUNTIES}) b
WHERE county IN (SELECT county FROM ({P_COUNTIES}) p)""")
def shapefile_counties_paired(spark, sf_dir):
    """Only counties that hold both layers, as the listing tells; no record of the other layer is read."""
    root = county_shapefiles(spark, sf_dir)
    b = _read_shp(spark, root, "GebauedeBauwerk", ["oid"], paired="NutzungFlurstueck", geometry=False)
    return b.select(F.col("oid").alias("building_oid"), F.col("county").cast("int").alias("county"))


FILES_SQL = f"""WITH b AS ({_dedup_first_sql(B_COUNTIES, 'building_oid')}),
p AS ({_dedup_first_sql(P_ALL, 'parcel_oid')})
SELECT {W} * {H} AS area, {geohash_sql(_CX, _CY, 5)} AS geom_hash, b.building_oid, b.funktion || '/' || b.aktualit AS gebnutzbez,
       CAST(b.building_oid % 7 AS VARCHAR) || '_31001' AS gfkzshh, CAST(NULL AS VARCHAR) AS name, CAST(b.building_oid % 5 AS INTEGER) AS anzahlgs,
       lpad(CAST(b.building_oid % 1000 AS VARCHAR), 8, '0') AS gmdschl, 'Straße ' || (b.building_oid % 97) AS lagebeztxt, b.funktion,
       p.parcel_oid AS flur_oid, p.nutzart, p.bez, lpad(CAST(p.parcel_oid AS VARCHAR), 12, '0') AS flstkennz
FROM b JOIN p ON {STRICT}"""


def full_shapefiles(spark, sf_dir) -> str:
    """All counties of both layers with every attribute the job reads, in nested folders; returns the root."""
    from ..session import register, scratch_dir
    from .job import BUILDINGS_LAYER, PARCELS_LAYER

    register(spark)
    key = (spark.sparkContext.applicationId, sf_dir, "full")
    if key not in _WRITTEN:
        root = scratch_dir(spark, "shapefiles")
        k = F.col("building_oid")
        b = fx.buildings_counties(spark, sf_dir).select(
            k.alias("oid"), F.concat_ws("/", "funktion", "aktualit").alias("gebnutzbez"),
            F.concat((k % 7).cast("string"), F.lit("_31001")).alias("gfkzshh"), F.lit(None).cast("string").alias("name"),
            (k % 5).cast("int").alias("anzahlgs"), F.lpad((k % 1000).cast("string"), 8, "0").alias("gmdschl"),
            F.concat(F.lit("Straße "), (k % 97).cast("string")).alias("lagebeztxt"), "funktion", "county", "geometry")
        k = F.col("parcel_oid")
        p = fx.parcels_counties(spark, sf_dir, None).select(
            k.alias("oid"), "nutzart", "bez", F.lpad(k.cast("string"), 12, "0").alias("flstkennz"), "county", "geometry")
        for df, layer in ((b, BUILDINGS_LAYER), (p, PARCELS_LAYER)):
            (df.repartition("county").write.format("shp").mode("overwrite")
               .option("layer", layer).option("partitionBy", "county").save(root))
        _WRITTEN[key] = root
    return _WRITTEN[key]


@query("shapefile_overlay_job", FILES_SQL)
def shapefile_overlay_job(spark, sf_dir):
    """The whole job from shapefiles to GeoParquet (P4, K1/K2), read back with the Parquet reader."""
    from ..session import scratch_dir
    from .job import RESULT_COLUMNS, run

    root = full_shapefiles(spark, sf_dir)
    out = scratch_dir(spark, "job-output")
    run(spark, [f"{root}-absent", root], out)
    return spark.read.parquet(out).select(st_area("geometry").alias("area"), "geom_hash", *RESULT_COLUMNS)


_COUNT_SQL = {
    "buildings_read": f"SELECT COUNT(*) FROM ({B_COUNTIES}) x", "buildings_kept": f"SELECT COUNT(DISTINCT building_oid) FROM ({B_COUNTIES}) x",
    "parcels_read": f"SELECT COUNT(*) FROM ({P_ALL}) x", "parcels_kept": f"SELECT COUNT(DISTINCT parcel_oid) FROM ({P_ALL}) x",
    "rows": f"SELECT COUNT(*) FROM ({FILES_SQL}) x",
}


@query("job_counts", " UNION ALL ".join(f"SELECT '{k}' AS measure, ({v}) AS n" for k, v in _COUNT_SQL.items()))
def job_counts(spark, sf_dir):
    """Rows read, kept and written by the job, observed during its writes (no counting pass)."""
    from ..session import scratch_dir
    from .job import run

    counts: dict = {}
    run(spark, [full_shapefiles(spark, sf_dir)], scratch_dir(spark, "job-output"), counts=counts)
    return spark.createDataFrame(list(counts.items()), "measure string, n long")


@query("job_persistent", f"SELECT * EXCLUDE (geom_hash) FROM ({FILES_SQL}) x")
def job_persistent(spark, sf_dir):
    """K5 with K4 and J8: the job's tables in buckets of their ids, attributes joined as the result is read."""
    from ..session import scratch_dir
    from .job import RESULT_COLUMNS, run

    saved = run(spark, [full_shapefiles(spark, sf_dir)], scratch_dir(spark, "job-tables"), save_name="tessera_job")
    return saved.select(st_area("geometry").alias("area"), *RESULT_COLUMNS)


@query("table_load_new", f"""SELECT building_oid, county, CASE WHEN county IN (1, 2) THEN 1 ELSE 2 END AS load
FROM ({B_COUNTIES}) b WHERE county <> 0 OR building_oid % 8 = 0""")
def table_load_new(spark, sf_dir):
    """A second load takes the new county and the changed one, and nothing else; a third takes none."""
    from ..operators.load import load_new, loaded
    from ..session import register, scratch_dir

    register(spark)
    root, target = scratch_dir(spark, "delivered"), scratch_dir(spark, "loaded")
    b = fx.buildings_counties(spark, sf_dir).select(F.col("building_oid").alias("oid"), "county", "geometry")

    def deliver(df):
        (df.repartition("county").write.format("shp").mode("overwrite")
           .option("layer", "GebauedeBauwerk").option("partitionBy", "county").save(root))

    def read(paths):
        return spark.read.format("shp").option("files", "\n".join(paths)).option("geometry", "false").load()

    pattern = f"{root}/*/GebauedeBauwerk.shp"
    deliver(b.where("county <> 3"))
    first = load_new(spark, pattern, target, read)
    deliver(b.where("county = 3 OR county = 0 AND oid % 8 = 0"))
    loads = [first, load_new(spark, pattern, target, read), load_new(spark, pattern, target, read)]
    assert loads == [3, 2, 0], loads
    return loaded(spark, target).select(F.col("oid").alias("building_oid"), F.col("county").cast("int").alias("county"), F.col("load").cast("int").alias("load"))


@query("shapefile_recursive", f"SELECT building_oid, county FROM ({B_COUNTIES}) b")
def shapefile_recursive(spark, sf_dir):
    """One layer in all folders below the root."""
    root = county_shapefiles(spark, sf_dir)
    df = (spark.read.format("shp").option("recursiveFileLookup", "true").option("columns", "oid")
          .load(f"{root}/GebauedeBauwerk*.shp"))
    return df.select(F.col("oid").alias("building_oid"), F.col("county").cast("int").alias("county"))


@query("geoparquet_roundtrip", OVERLAY_SQL)
def geoparquet_roundtrip(spark, sf_dir):
    """K1/K2: overlay written as GeoParquet (zstd, CRS in the footer), read back."""
    from ..session import register, scratch_dir

    register(spark)
    out = scratch_dir(spark, "gpq")
    b, p = _layers(spark, sf_dir)
    (overlay(b, p).write.format("gpq").mode("overwrite").option("crs", "EPSG:25833")
        .option("compression", "zstd").save(out))
    return _overlay_out(spark.read.parquet(out))


@query("table_append", f"SELECT building_oid, funktion, county FROM ({B_COUNTIES}) b")
def table_append(spark, sf_dir):
    """Append county layers one by one into a Parquet table, read it back."""
    from ..session import scratch_dir

    path = scratch_dir(spark, "table")
    df = fx.buildings_counties(spark, sf_dir).select("building_oid", "funktion", "county")
    for c in range(4):
        # One parameterised statement, run once per county file
        part = spark.sql("SELECT building_oid, funktion, county FROM {layer} WHERE county = :county",
                         args={"county": c}, layer=df)
        part.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query("geoparquet_empty", "SELECT building_oid FROM (SELECT o_orderkey AS building_oid FROM orders) o WHERE building_oid < 0")
def geoparquet_empty(spark, sf_dir):
    """K1: a result without rows is still a readable table."""
    from ..session import register, scratch_dir

    register(spark)
    out = scratch_dir(spark, "gpq-empty")
    fx.buildings_rect(spark, sf_dir).where("building_oid < 0").write.format("gpq").mode("overwrite").save(out)
    return spark.read.parquet(out).select("building_oid")


@query("geoparquet_overwrite", f"SELECT parcel_oid, nutzart FROM ({P_GRID}) p")
def geoparquet_overwrite(spark, sf_dir):
    """K9: writing twice leaves the second result only."""
    from ..session import register, scratch_dir

    register(spark)
    out = scratch_dir(spark, "gpq-twice")
    for df in (fx.buildings_rect(spark, sf_dir).selectExpr("building_oid parcel_oid", "funktion nutzart", "geometry"),
               fx.parcels_grid(spark, sf_dir).select("parcel_oid", "nutzart", "geometry")):
        df.write.format("gpq").mode("overwrite").save(out)
    return spark.read.parquet(out).select("parcel_oid", "nutzart")


@query("table_ctas", f"WITH b AS ({B_RECT}), p AS ({P_GRID}) SELECT b.building_oid, p.parcel_oid FROM b JOIN p ON {CLOSED}")
def table_ctas(spark, sf_dir):
    """K4 / K5 / K6: the id-only join as a persistent table under an explicit path; a table of that name is dropped first."""
    from ..session import scratch_dir

    path = scratch_dir(spark, "ctas")
    b, p = _layers(spark, sf_dir)
    spark.sql("DROP TABLE IF EXISTS tessera_buildings_intersection")
    spark.sql(f"CREATE TABLE tessera_buildings_intersection USING parquet LOCATION '{path}' AS "
              "SELECT building_oid, parcel_oid FROM {pairs}", pairs=spatial_join(b, p).select("building_oid", "parcel_oid"))
    spark.sql("DROP TABLE IF EXISTS tessera_buildings_intersection")  # an external table: its files stay
    return spark.read.parquet(path)


@query("table_reuse", f"SELECT parcel_oid, nutzart FROM ({P_GRID}) p")
def table_reuse(spark, sf_dir):
    """Prepared input is made once and reused; only ``refresh`` makes it again."""
    from ..session import scratch_dir
    from .job import prepared

    path = scratch_dir(spark, "prepared")
    p = fx.parcels_grid(spark, sf_dir).select("parcel_oid", "nutzart")
    prepared(spark, path, lambda: p.limit(0))
    assert prepared(spark, path, lambda: p).isEmpty()
    return prepared(spark, path, lambda: p, refresh=True)


@query("export_zstd", OVERLAY_SQL)
def export_zstd(spark, sf_dir):
    """K3: a view exported as plain Parquet with zstd."""
    from ..session import scratch_dir

    out = scratch_dir(spark, "export")
    b, p = _layers(spark, sf_dir)
    overlay(b, p).createOrReplaceTempView("tessera_export")
    spark.table("tessera_export").write.option("compression", "zstd").parquet(out)
    spark.sql("DROP VIEW IF EXISTS tessera_export")
    return _overlay_out(spark.read.parquet(out))


# ------------------------------------------- multipart features, enclaves

TWO_PARTS = """SELECT c_custkey AS building_oid, CAST((c_custkey * 7919) % 985 AS DOUBLE) AS x,
       CAST((c_custkey * 104729) % 190 AS DOUBLE) AS y FROM customer"""


def _part_area(dx: int) -> str:
    return (f"GREATEST(0, LEAST(x + {dx} + 2, maxx) - GREATEST(x + {dx}, minx)) * "
            "GREATEST(0, LEAST(y + 2, maxy) - GREATEST(y, miny))")


def _part_meets(dx: int) -> str:
    return f"(x + {dx} <= maxx AND minx <= x + {dx} + 2 AND y <= maxy AND miny <= y + 2)"


@query("overlay_multipart", f"""WITH b AS ({TWO_PARTS}), p AS ({P_GRID})
SELECT building_oid, parcel_oid, {_part_area(0)} + {_part_area(12)} AS area
FROM b JOIN p ON {_part_area(0)} + {_part_area(12)} > 0""")
def overlay_multipart(spark, sf_dir):
    """J3 on two-part features, one part often inside a parcel without touching it, in both part orders."""
    o = overlay(fx.buildings_two_parts(spark, sf_dir), fx.parcels_grid(spark, sf_dir))
    return o.select("building_oid", "parcel_oid", st_area("geometry").alias("area"))


@query("spatial_join_multipart", f"""WITH b AS ({TWO_PARTS}), p AS ({P_GRID})
SELECT building_oid, parcel_oid FROM b JOIN p ON {_part_meets(0)} OR {_part_meets(12)}""")
def spatial_join_multipart(spark, sf_dir):
    """J1 on two-part features."""
    return spatial_join(fx.buildings_two_parts(spark, sf_dir), fx.parcels_grid(spark, sf_dir)).select("building_oid", "parcel_oid")


@query("overlay_enclave", """SELECT c_custkey AS building_oid,
       CAST((c_custkey // 100) % 2 * 100 + c_custkey % 100 AS BIGINT) AS parcel_oid,
       CAST(5 * (5 + c_custkey % 3) - 4 AS DOUBLE) AS area FROM customer""")
def overlay_enclave(spark, sf_dir):
    """J3 of boxes that cover a parcel's hole and touch none of its edges."""
    o = overlay(fx.buildings_over_enclave(spark, sf_dir), fx.parcels_enclave(spark, sf_dir))
    return o.select("building_oid", "parcel_oid", st_area("geometry").alias("area"))


# ------------------------------------ very large features, indexed small side

def _share(x0: str, y0: str, x1: str, y1: str) -> str:
    return f"GREATEST(0, LEAST({x1}, maxx) - GREATEST({x0}, minx)) * GREATEST(0, LEAST({y1}, maxy) - GREATEST({y0}, miny))"


_W, _T, _H = fx.WIDE_L
_WIDE_AREA = f"{_share('x', 'y', f'x + {_W}', f'y + {_T}')} + {_share('x', f'y + {_T}', f'x + {_T}', f'y + {_H}')}"


@query("overlay_subdivided", f"""WITH b AS (SELECT s_suppkey AS area_oid, CAST(s_suppkey * 37 % 395 AS DOUBLE) AS x, CAST(s_suppkey * 3 % 10 AS DOUBLE) AS y FROM supplier),
p AS ({P_GRID}), c AS (SELECT area_oid, parcel_oid, nutzart, {_WIDE_AREA} AS area FROM b JOIN p ON {_WIDE_AREA} > 0)
SELECT *, 'Polygon' AS geom_type FROM c""")
def overlay_subdivided_q(spark, sf_dir):
    """J1 / J3 on features over hundreds of cells: cut, clipped per piece, united per pair."""
    from ..operators.subdivide import overlay_subdivided

    o = overlay_subdivided(fx.wide_lshapes(spark, sf_dir), fx.parcels_grid(spark, sf_dir).select("parcel_oid", "nutzart", "geometry", "bbox"))
    return o.select("area_oid", "parcel_oid", "nutzart", st_area("geometry").alias("area"), st_geometry_type("geometry").alias("geom_type"))


@query("overlay_indexed", OVERLAY_SQL)
def overlay_indexed_q(spark, sf_dir):
    """The smaller layer as a packed index in every task; no cells, no shuffle."""
    from ..operators.packed_index import overlay_indexed

    b, p = _layers(spark, sf_dir)
    return _overlay_out(overlay_indexed(b, p, max_broadcast_bytes=64 << 20))


@query("overlay_counties_pruned", f"""WITH b AS ({B_COUNTIES}), p AS ({P_COUNTIES})
SELECT b.building_oid, p.parcel_oid, b.county, {W} * {H} AS area
FROM b JOIN p ON b.county = p.county AND {STRICT} WHERE b.county IN (SELECT n_nationkey % 5 FROM nation WHERE n_nationkey % 5 BETWEEN 1 AND 2)""")
def overlay_counties_pruned(spark, sf_dir):
    """Layers saved by county; which counties are scanned a query tells at run time."""
    from ..session import scratch_dir
    from .job import overlay_counties, save_by_county

    b = save_by_county(fx.buildings_counties(spark, sf_dir).select(F.col("building_oid").alias("oid"), "geometry", "bbox", "county"), scratch_dir(spark, "by-county"))
    p = save_by_county(fx.parcels_counties(spark, sf_dir).select(F.col("parcel_oid").alias("oid"), "geometry", "bbox", "county"), scratch_dir(spark, "by-county"))
    wanted = fx.table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).cast("int").alias("county")).where("county BETWEEN 1 AND 2")
    o = overlay_counties(b, p, wanted)
    return o.select("building_oid", F.col("flur_oid").alias("parcel_oid"), "county", st_area("geometry").alias("area"))
