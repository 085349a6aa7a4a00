"""Shapefile and GeoParquet round trips."""

import json
import os
import tempfile

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessera.functions import st_area, st_geometry_type
from tessera.functions import wkb
from tessera.functions.wkb import Shape, box_ring
from tessera.plans.job import layer_paths, resolve_root
from tessera.sources.shapefile import write_shapefile


def _write_fixture(root):
    import datetime as dt

    import pyarrow as pa

    holed = wkb.encode(Shape(polygons=[[box_ring(0, 0, 3, 3), box_ring(1, 1, 2, 2)[::-1]]]))
    multi = wkb.encode(Shape(polygons=[[box_ring(0, 0, 1, 1)], [box_ring(5, 5, 7, 7)]]))
    geoms = [holed, multi, None]
    cols = {
        "oid": pa.array(["A1", "A2", "A3"]),
        "n9": pa.array([1, None, 3], type=pa.int32()),
        "n18": pa.array([10 ** 12, 2, None], type=pa.int64()),
        "f": pa.array([1.5, None, -2.25]),
        "d": pa.array([dt.date(2020, 1, 2), None, dt.date(1999, 12, 31)]),
        "b": pa.array([True, False, None]),
        "txt": pa.array(["Straße", "", None]),
        "allnull": pa.array([None, None, None], type=pa.string()),
    }
    write_shapefile(f"{root}/c1/GebauedeBauwerk", geoms, cols)
    write_shapefile(f"{root}/c1/NutzungFlurstueck", geoms[:1], {"oid": pa.array(["P"])})


def test_shapefile_types_shapes_and_nulls(spark):
    root = tempfile.mkdtemp(prefix="tessera-shp-")
    _write_fixture(root)
    df = spark.read.format("shp").load(f"{root}/*/GebauedeBauwerk.shp")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert types["n9"] == "int" and types["n18"] == "bigint" and types["f"] == "double"
    assert types["d"] == "date" and types["b"] == "boolean" and types["txt"] == "string"
    rows = {r["oid"]: r for r in df.select("*", st_area("geometry").alias("a"),
                                            st_geometry_type("geometry").alias("t")).collect()}
    assert rows["A1"]["a"] == 8.0 and rows["A1"]["t"] == "Polygon"
    assert rows["A2"]["a"] == 5.0 and rows["A2"]["t"] == "MultiPolygon"
    assert rows["A3"]["geometry"] is None and rows["A3"]["bbox"] is None
    assert rows["A1"]["txt"] == "Straße" and rows["A1"]["n18"] == 10 ** 12
    assert rows["A2"]["n9"] is None and rows["A3"]["allnull"] is None
    assert rows["A1"]["county"] == "c1" and rows["A2"]["record_no"] == 1


def test_latin1_encoding(spark):
    import pyarrow as pa

    root = tempfile.mkdtemp(prefix="tessera-shp-")
    write_shapefile(f"{root}/x/L", [wkb.encode(Shape(polygons=[[box_ring(0, 0, 1, 1)]]))],
                    {"name": pa.array(["Grüße"])})
    stem = f"{root}/x/L"
    raw = open(stem + ".dbf", "rb").read().replace("Grüße".encode("utf-8"), "Grüße".encode("latin-1") + b"  ")
    open(stem + ".dbf", "wb").write(raw)
    open(stem + ".cpg", "w").write("ISO-8859-1")
    assert spark.read.format("shp").load(stem + ".shp").first()["name"] == "Grüße"


def test_discovery_errors():
    empty = tempfile.mkdtemp(prefix="tessera-empty-")
    with pytest.raises(FileNotFoundError):
        resolve_root([empty, empty + "/nothing"])
    root = tempfile.mkdtemp(prefix="tessera-shp-")
    _write_fixture(root)
    assert resolve_root([empty, root]) == root
    os.remove(f"{root}/c1/NutzungFlurstueck.shp")
    with pytest.raises(FileNotFoundError):
        layer_paths(root)


def test_geoparquet_footer(spark):
    from tessera.plans import fixtures as fx

    out = tempfile.mkdtemp(prefix="tessera-gpq-")
    b = fx.buildings_rect(spark, "/root/testdata/sf0.001")
    b.write.format("gpq").mode("overwrite").option("crs", "EPSG:25833").save(out)
    files = [f for f in os.listdir(out) if f.endswith(".parquet")]
    assert files and not os.path.exists(f"{out}/_temporary/x")
    geo = json.loads(pq.ParquetFile(f"{out}/{files[0]}").metadata.metadata[b"geo"])
    assert geo["version"] == "1.0.0" and geo["primary_column"] == "geometry"
    col = geo["columns"]["geometry"]
    assert col["encoding"] == "WKB" and col["geometry_types"] == ["Polygon"]
    assert col["crs"]["id"]["code"] == 25833 and len(col["bbox"]) == 4
    assert spark.read.parquet(out).count() == b.count()
    b.limit(10).write.format("gpq").mode("overwrite").save(out)
    assert spark.read.parquet(out).count() == 10
    meta = json.loads(pq.ParquetFile(f"{out}/{[f for f in os.listdir(out) if f.endswith('.parquet')][0]}")
                      .metadata.metadata[b"geo"])
    assert "crs" not in meta["columns"]["geometry"]
