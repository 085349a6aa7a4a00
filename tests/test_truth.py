"""Cases where a value, a ring, a record or a row must be kept, or an error raised."""

import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import batch, bbox_of, geometry as g, st_geometry_type, st_make_envelope, st_multi, wkb
from tessera.operators.spatial_join import candidate_pairs, spatial_join
from tessera.plans import job
from tessera.sources import fs, shapefile


def square(x, y, size=2.0):
    return np.array([(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)], float)


def write(stem, names, geoms=None, **columns):
    geoms = geoms or [wkb.polygon_bytes([square(i, 0)]) for i in range(len(names))]
    shapefile.write_shapefile(str(stem), geoms, {"oid": pa.array(names), **columns})


def test_multipart_and_enclave_intersections():
    a = wkb.Shape(polygons=[[square(1, 1)], [square(50, 50)]])
    b = wkb.Shape(polygons=[[square(50, 50)], [square(1, 1)]])
    tile = wkb.Shape(polygons=[[square(0, 0, 10)]])
    for shape in (a, b):
        assert g.intersects(shape, tile) and g.intersects(tile, shape)
        assert sum(abs(g.ring_area2(r)) / 2 for p in g.intersection(shape, tile).polygons for r in p) == 4
    holed = wkb.Shape(polygons=[[square(0, 0, 10), square(4, 4)[::-1]]])
    cover = wkb.Shape(polygons=[[square(2, 2, 6)]])
    assert sum(g.ring_area2(r) / 2 for p in g.intersection(cover, holed).polygons for r in p) == 32
    inside = wkb.Shape(polygons=[[square(4.5, 4.5, 1)]])
    assert not g.intersects(inside, holed) and not g.intersection(inside, holed).polygons


def test_dbf_keeps_values_or_raises(tmp_path, spark):
    big = [1234567890123456789, -(1 << 63), 7]
    write(tmp_path / "c/L", ["a", "b", "c"], n=pa.array(big), d=pa.array([0.1 + 0.2, 1e-300, -1.5e300]))
    rows = spark.read.format("shp").load(f"{tmp_path}/c/L.shp").orderBy("record_no").collect()
    assert [r.n for r in rows] == big and [r.d for r in rows] == [0.1 + 0.2, 1e-300, -1.5e300]
    with pytest.raises(ValueError):
        write(tmp_path / "x", ["é" * 200])
    with pytest.raises(ValueError):
        shapefile.write_dbf({"attribute_one": pa.array([1])})
    with pytest.raises(ValueError):
        write(tmp_path / "y", ["a"], [wkb.encode(wkb.Shape(points=[np.zeros(2), np.ones(2)]))])


def test_clashing_fields_deleted_records_and_encoding(tmp_path, spark):
    write(tmp_path / "k1/L", ["Grün", "weg", "da"], county=pa.array(["p", "q", "r"]))
    (tmp_path / "k1/L.cpg").unlink()
    dbf = bytearray((tmp_path / "k1/L.dbf").read_bytes())
    head, = struct.unpack_from("<H", dbf, 8)
    size, = struct.unpack_from("<H", dbf, 10)
    dbf[head + size] = 0x2A
    at = dbf.index("Grün".encode())
    dbf[at : at + 5] = "Grün".encode("latin-1") + b" "
    (tmp_path / "k1/L.dbf").write_bytes(dbf)
    rows = spark.read.format("shp").load(f"{tmp_path}/*/L.shp").orderBy("record_no").collect()
    assert [(r.oid, r.county_attr, r.county) for r in rows] == [("Grün", "p", "k1"), ("da", "r", "k1")]


def test_reader_splits_by_bytes(tmp_path, spark):
    names = [f"n{i}" for i in range(50)]
    write(tmp_path / "k/L", names, num=pa.array(range(50)))
    df = (spark.read.format("shp").option("bytesPerPartition", "2000").option("bytesPerBatch", "500").load(f"{tmp_path}/*/L.shp"))
    rows = df.orderBy("record_no").collect()
    assert [(r.oid, r.num, r.record_no, r.bbox.minx) for r in rows] == [(n, i, i, float(i)) for i, n in enumerate(names)]
    assert df.rdd.getNumPartitions() == -(-(tmp_path / "k/L.shp").stat().st_size // 2000)


def test_reader_keeps_all_rings():
    def record(rings):
        pts = np.vstack(rings)
        parts = np.cumsum([0] + [len(r) for r in rings[:-1]]).astype("<i4")
        return struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(rings), len(pts)) + parts.tobytes() + pts.astype("<f8").tobytes()

    bow = np.array([(20, 0), (22, 2), (22, 0), (20, 2), (20, 0)], float)
    for second in (bow, square(30, 30)):
        shape = wkb.parse(shapefile.shape_to_wkb(record([square(0, 0)[::-1], second]))[0])
        assert len(shape.polygons) == 2
    shape = wkb.parse(shapefile.shape_to_wkb(record([square(0, 0, 9)[::-1], square(2, 2)]))[0])
    assert [len(p) for p in shape.polygons] == [2]
    with pytest.raises(ValueError):
        shapefile.shape_to_wkb(struct.pack("<i", 31) + bytes(40))


def test_glob_stays_inside_its_segments(tmp_path):
    for folder in ("a", "a/b", "_temporary/t/a", "c"):
        write(tmp_path / folder / "L", ["x"])
    found = fs.expand(f"{tmp_path}/*/L.shp")
    assert [f[len(str(tmp_path)):] for f in found] == ["/a/L.shp", "/c/L.shp"]
    assert len(fs.expand(f"{tmp_path}/L*.shp", recursive=True)) == 3
    assert fs.expand(str(tmp_path)) == []


def test_geoparquet_footer_and_row_groups(tmp_path, spark):
    df = spark.range(5000).select("id", st_make_envelope(*(F.col("id").cast("double") + k for k in (0, 0, 1, 1))).alias("geometry")).coalesce(1)
    df.write.format("gpq").mode("overwrite").option("crs", "EPSG:25833").option("row_group_size", "2000").save(f"{tmp_path}/o")
    assert sorted(p.suffix for p in (tmp_path / "o").iterdir()) == [".parquet"]
    meta = pq.read_metadata(next((tmp_path / "o").glob("*.parquet")))
    crs = json.loads(meta.metadata[b"geo"])["columns"]["geometry"]["crs"]
    assert meta.num_rows == 5000 and meta.num_row_groups <= 5 and {"base_crs", "conversion", "coordinate_system"} <= set(crs)
    with pytest.raises(ValueError):
        shapefile.crs_projjson("EPSG:4326")


def test_job_without_input(tmp_path, spark):
    assert job.run(spark, [str(tmp_path)], f"{tmp_path}/out", on_missing="skip") is None
    with pytest.raises(FileNotFoundError):
        job.run(spark, [str(tmp_path)], f"{tmp_path}/out")


def test_hot_cell_is_split_on_both_sides(spark):
    box = [F.lit(float(x)) for x in (0, 0, 1, 1)]
    side = lambda name, n: spark.range(n).select(F.col("id").alias(name), st_make_envelope(*box).alias("geometry"), bbox_of(*box).alias("bbox"))
    pairs, plan = candidate_pairs(side("a", 300), side("b", 200), hot_cell_rows=50)
    assert plan.hot_cells >= 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else so few rows are put into one partition again
    try:
        tasks = [r[1] for r in pairs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(tasks) == 60_000 and len(tasks) > 4
    assert spatial_join(side("a", 30), side("b", 20), hot_cell_rows=4).distinct().count() == 600


def test_headers_are_read_and_rewritten_in_the_jvm(spark):
    def polygon(order, flags, dims, srid=b"", rings=1):
        head = bytes([order == "<"]) + struct.pack(order + "I", flags) + srid + struct.pack(order + "I", rings)
        return head + (struct.pack(order + "I", 5) + np.hstack([square(1, 1), np.zeros((5, dims - 2))]).astype(order + "f8").tobytes() if rings else b"")

    values = [polygon(o, f, d) for o in "<>" for f, d in ((3, 2), (1003, 3), (2003, 3), (3003, 4), (0x80000003, 3))]
    values += [polygon(o, 0x20000003, 2, struct.pack(o + "I", 25833)) for o in "<>"] + [polygon("<", 3, 2, rings=0), wkb.point_bytes(np.ones(2)), None]
    values += [wkb.encode_multipolygon([[square(0, 0)]])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, g binary")
    rows = df.select("g", st_multi("g").alias("m"), st_geometry_type("g").alias("t"), st_geometry_type(st_multi("g")).alias("u")).orderBy("i").collect()
    assert [r.t for r in rows] == ["Polygon"] * 13 + ["Point", None, "MultiPolygon"]
    assert [r.u for r in rows] == ["MultiPolygon"] * 13 + ["Point", None, "MultiPolygon"]
    for r in rows:
        if r.g is not None:
            old, new = wkb.parse(r.g), wkb.parse(r.m)
            assert len(old.polygons) == len(new.polygons) and np.array_equal(old.coords(), new.coords())
            assert wkb.parse(batch.multi_one(bytes(r.g))).coords().tolist() == new.coords().tolist()
