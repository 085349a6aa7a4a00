"""Columnar shapefile decoding, filters in the scan, dedup in two phases, ordered and persistent results, loads by manifest."""

import datetime as dt
import os
import struct

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, Not, StringStartsWith

from tessera.functions import st_area, st_is_valid, wkb
from tessera.functions.wkb import Shape, box_ring
from tessera.operators.dedup import drop_duplicates_first
from tessera.operators.load import load_new, loaded, manifest
from tessera.operators.overlay import overlay
from tessera.operators.repair import repair
from tessera.operators.spatial_join import spatial_join
from tessera.plans import catalog, job
from tessera.plans import fixtures as fx
from tessera.sources import columnar, shapefile
from tessera.sources.shapefile import ShapefileDataSource, write_shapefile


def cells(*values, width=None):
    raw = [v if isinstance(v, bytes) else v.encode() for v in values]
    width = width or max(map(len, raw))
    return np.frombuffer(b"".join(v.ljust(width) for v in raw), np.uint8).reshape(len(raw), width)


def box(x, y, w=1.0, h=1.0):
    return wkb.encode(Shape(polygons=[[box_ring(x, y, x + w, y + h)]]))


# --- attributes

def test_text_columns():
    assert columnar.texts(cells("ab", "", " c ", "Straße", "x\x00\x00", "  "), "utf-8").to_pylist() == ["ab", None, " c", "Straße", "x", None]
    assert columnar.texts(cells("Grüße €".encode("cp1252"), b"plain"), "cp1252").to_pylist() == ["Grüße €", "plain"]
    assert columnar.texts(cells("Grüße".encode("latin-1"), "é à".encode("latin-1")), "latin-1").to_pylist() == ["Grüße", "é à"]
    assert columnar.texts(cells("中文".encode("gbk"), b"a"), "gbk").to_pylist() == ["中文", "a"]
    assert columnar.texts(cells(b"\xff\xfe"), "latin-1").to_pylist() == ["ÿþ"]
    with pytest.raises(pa.ArrowInvalid):
        columnar.texts(cells(b"\xff\xfe"), "utf-8")
    with pytest.raises(UnicodeDecodeError):
        columnar.texts(cells(b"\x81"), "cp1252")
    assert columnar.texts(np.zeros((0, 5), np.uint8), "utf-8").to_pylist() == []


def test_number_columns():
    assert columnar.whole_numbers(cells("  12", "-3", "", "***", "007"), "n").to_pylist() == [12, -3, None, None, 7]
    assert columnar.whole_numbers(cells("12.0", "+5", "abc", "1e3", " 9 "), "n").to_pylist() == [12, 5, None, 1000, 9]
    with pytest.raises(ValueError, match="field size has no decimals but holds 2.5"):
        columnar.whole_numbers(cells("1", "2.5"), "size")
    assert columnar.numbers(cells("1.5", "-2.25e1", "", "*", "3", ".5", "x")).to_pylist() == [1.5, -22.5, None, None, 3.0, 0.5, None]


def test_date_and_flag_columns():
    found = columnar.dates(cells("20200229", "20210229", "19691231", "2020 101", "", "00000000", "99991231", "20201301", width=8))
    assert found.to_pylist() == [dt.date(2020, 2, 29), None, dt.date(1969, 12, 31), None, None, None, dt.date(9999, 12, 31), None]
    assert columnar.dates(cells("2020")).to_pylist() == [None]
    assert columnar.flags(cells("T", "f", "?", "Y", "n", " ")).to_pylist() == [True, False, None, True, False, None]


# --- records

def record(kind, rings):
    points = np.vstack(rings)
    starts = np.cumsum([0, *(len(r) for r in rings[:-1])]).astype("<i4")
    edges = (*points.min(axis=0), *points.max(axis=0))
    return struct.pack("<i4d2i", kind, *edges, len(rings), len(points)) + starts.tobytes() + points.astype("<f8").tobytes()


def laid_out(records):
    at = np.cumsum([0, *(len(r) for r in records[:-1])])
    return np.frombuffer(b"".join(records), np.uint8), at.astype(np.int64), np.array([len(r) for r in records], np.int64)


def test_records_of_one_ring_are_decoded_together():
    square = np.array([[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]], float)
    rng = np.random.default_rng(1)
    stars = []
    for n in (3, 4, 7, 7, 12):
        a = np.sort(rng.uniform(0, 6.28, n))
        r = np.c_[np.cos(a), np.sin(a)] * rng.uniform(1, 3, (n, 1)) + 500_000
        stars.append(np.vstack([r, r[:1]]))
    rings = [square, square[::-1], *stars, *(s[::-1] for s in stars)]
    hard = [record(5, [square[:-1]]), record(5, [np.vstack([square[:2], square[1:]])]), record(5, [square, square + 5]), record(5, [square * 4, square[::-1] + 1]),
            struct.pack("<i", 0), struct.pack("<i2d", 1, 3.0, 4.0), record(3, [square]), record(5, [square[:2]])]
    records = [record(15 if k % 3 == 0 else 5, [r]) for k, r in enumerate(rings)] + hard
    shp, at, size = laid_out(records)
    kind, boxes = columnar.headers(shp, at, size)
    fast, _ = columnar.single_rings(shp, at, size, kind)
    assert sorted(fast.tolist()) == list(range(len(rings)))
    plain = [shapefile.shape_to_wkb(r) for r in records]
    assert shapefile._geometries(shp, at, size, kind).to_pylist() == [g for g, _ in plain]
    for mine, (_, other) in zip(boxes, plain, strict=True):
        assert np.isnan(mine).all() if other is None else tuple(mine) == tuple(other)


def test_a_short_ring_is_kept_for_repair(spark, tmp_path):
    write_shapefile(f"{tmp_path}/c/L", [box(0, 0), box(5, 5)], {"oid": pa.array(["a", "b"])})
    body = record(5, [np.array([[0, 0], [1, 1], [0, 0.0]])])
    with open(f"{tmp_path}/c/L.shp", "r+b") as f:  # the first record becomes a line there and back
        f.seek(108)
        f.write(body)
        f.seek(104)
        f.write(struct.pack(">i", len(body) // 2))
    with open(f"{tmp_path}/c/L.shx", "r+b") as f:
        f.seek(104)
        f.write(struct.pack(">i", len(body) // 2))
    df = spark.read.format("shp").load(f"{tmp_path}/c/L.shp")
    assert {r.oid: r.v for r in df.select("oid", st_is_valid("geometry").alias("v")).collect()} == {"a": False, "b": True}
    assert {r.oid: r.a for r in repair(df).select("oid", st_area("geometry").alias("a")).collect()}["b"] == 1.0


# --- filters in the scan

@pytest.fixture(scope="module")
def counties(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("counties"))
    for c in "123":
        write_shapefile(f"{root}/{c}/L", [box(i, int(c)) for i in range(50)] + [None], {"oid": pa.array([f"{c}-{i}" for i in range(51)])})
    write_shapefile(f"{root}/2/M", [box(0, 0)], {"oid": pa.array(["m"])})
    return root


def reader(root, **options):
    source = ShapefileDataSource({"path": f"{root}/*/L.shp", **options})
    return source.reader(source.schema())


def test_filters_leave_out_files_and_records(counties, monkeypatch):
    decoded = []
    real = shapefile._geometries
    monkeypatch.setattr(shapefile, "_geometries", lambda shp, at, *rest: decoded.append(len(at)) or real(shp, at, *rest))
    r = reader(counties)
    others = [Not(EqualTo(("county",), "1")), EqualTo(("oid",), "2-3"), GreaterThan(("bbox",), 1)]
    kept = list(r.pushFilters([EqualTo(("county",), "2"), GreaterThan(("bbox", "minx"), 9.5), LessThanOrEqual(("bbox", "maxx"), 20), IsNotNull(("bbox", "minx")), *others]))
    assert kept == others
    parts = r.partitions()
    assert [os.path.dirname(p.path)[-1] for p in parts] == ["2"]
    rows = pa.Table.from_batches([b for p in parts for b in r.read(p)]).to_pylist()
    assert [x["oid"] for x in rows] == [f"2-{i}" for i in range(10, 20)] and [x["record_no"] for x in rows] == list(range(10, 20))
    assert sum(decoded) == 10


def test_filters_on_files(counties):
    for f, want in ((In(("county",), ["1", "3", "9"]), "13"), (StringStartsWith(("source_file",), f"{counties}/3"), "3"), (EqualTo(("county",), "9"), "")):
        r = reader(counties)
        assert list(r.pushFilters([f])) == []
        assert "".join(os.path.dirname(x)[-1] for x in r.files) == want
        assert list(r.read(r.partitions()[0])) == [] if not want else r.partitions()


def test_filters_through_spark(spark, counties):
    df = spark.read.format("shp").load(f"{counties}/*/L.shp")
    some = df.where("county = '3' AND bbox.minx >= 48")
    assert sorted(r.oid for r in some.collect()) == ["3-48", "3-49"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan
    assert df.where("bbox IS NOT NULL").count() == 150 and df.where("oid = '1-50'").first()["bbox"] is None
    assert df.where("bbox.minx >= 48 OR oid = '1-3'").count() == 7


def test_a_listing_pairs_folders(spark, counties, monkeypatch):
    df = job.read_layer(spark, f"{counties}/*/L.shp", ["oid"], paired_with=f"{counties}/*/M.shp", geometry=False)
    assert "geometry" not in df.columns
    assert {r.county for r in df.select("county").distinct().collect()} == {"2"}
    with pytest.raises(Exception, match="no shapefile matches"):
        job.read_layer(spark, f"{counties}/*/L.shp", paired_with=f"{counties}/*/absent.shp").count()


def test_one_listing_gives_all_sizes(counties, monkeypatch):
    r = reader(counties)
    monkeypatch.setattr(shapefile.fs, "filesystem", lambda path: pytest.fail("a file was looked up"))
    assert [(p.start, p.end) for p in r.partitions()] == [(0, 51)] * 3


# --- dedup, order, tables

def test_keep_first_aggregates_places_alone(spark):
    rows = [("k", "b", 1, "x"), ("k", "a", 5, "y"), ("k", "a", 2, "z"), (None, "a", 9, "n"), (None, "b", 0, "m"), ("u", "c", 3, "w"), ("t", None, None, "p"), ("k", "a", 2, "z")]
    df = spark.createDataFrame(rows, "oid string, source_file string, record_no long, geometry string").repartition(3)
    out = drop_duplicates_first(df)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("k", "a", 2, "z"), (None, "a", 9, "n"), ("u", "c", 3, "w"), ("t", None, None, "p")], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    by_name = drop_duplicates_first(df, "oid", ("source_file", "geometry"))
    assert {(r.oid, r.geometry) for r in by_name.collect()} == {("k", "y"), (None, "n"), ("u", "w"), ("t", "p")}


def test_results_are_in_order_of_location(spark):
    b, p = fx.buildings_rect(spark, SF_SMALL), fx.parcels_grid(spark, SF_SMALL)
    for scale in (1.0, 0.0001):  # metres: no geohash; degrees: all have one
        res = overlay(b, p).select("building_oid", "parcel_oid", "geometry")
        keyed = res.withColumns({"geom_hash": F.when(F.lit(scale < 1), F.expr("substring(lower(hex(xxhash64(building_oid % 40))), 1, 5)")), "grid_hash": F.xxhash64("building_oid") % 1000})
        keyed = keyed.withColumn("geom_hash", F.translate("geom_hash", "a", "b")).withColumn("grid_hash", F.abs("grid_hash"))
        sample = keyed.select("geom_hash", "grid_hash")
        out = job.location_ordered(keyed, sample=sample, ranges=6)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan
        rows = [((r.geom_hash or ""), r.grid_hash, r.p) for r in out.select("geom_hash", "grid_hash", F.spark_partition_id().alias("p")).collect()]
        assert len(rows) == res.count() and len({p for _, _, p in rows}) > 3
        assert rows == sorted(rows)


def test_rows_at_one_location_are_dealt_over_several_ranges(spark):
    same = F.lit(None).cast("string").alias("geom_hash")
    for grid in (F.lit(7), F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("id") % 3 + 5), F.when(F.col("id") % 8 == 0, F.col("id")).otherwise(F.lit(1 << 30))):
        df = spark.range(0, 20_000, numPartitions=3).select("id", same, grid.cast("long").alias("grid_hash"))
        out = job.location_ordered(df, sample=df.select("geom_hash", "grid_hash"), ranges=8)
        rows = [(-1 if r.grid_hash is None else r.grid_hash, r.p) for r in out.select("grid_hash", F.spark_partition_id().alias("p")).collect()]
        assert len(rows) == 20_000 and rows == sorted(rows)
        assert max(sum(p == k for _, p in rows) for k in range(8)) < 5_000
    few = spark.range(3).select("id", same, F.lit(1).cast("long").alias("grid_hash"))
    assert job.location_ordered(few, sample=few.limit(0), ranges=8).count() == job.location_ordered(few, sample=few, ranges=1).count() == 3


def test_counts_come_with_the_writes(spark, tmp_path):
    root = catalog.full_shapefiles(spark, SF_SMALL)
    counts: dict = {}
    out = job.run(spark, [root], f"{tmp_path}/out", counts=counts)
    assert counts["rows"] == out.count() > 0
    assert counts["buildings_read"] > counts["buildings_kept"] == spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()


def test_county_wise_job_reads_each_layer_once(spark, tmp_path):
    root = catalog.county_shapefiles(spark, SF_SMALL)
    counts: dict = {}
    names = job.BUILDING_COLUMNS, job.PARCEL_COLUMNS
    b = job.read_layer(spark, f"{root}/*/{job.BUILDINGS_LAYER}.shp", ["oid"], paired_with=f"{root}/*/{job.PARCELS_LAYER}.shp")
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Join" not in plan
    assert {r.county for r in b.select("county").distinct().collect()} == {"0", "1", "2"}
    assert counts == {} and names


def test_saved_tables_join_without_an_exchange(spark, tmp_path):
    root = catalog.full_shapefiles(spark, SF_SMALL)
    saved = job.run(spark, [root], f"{tmp_path}/tables", save_name="tessera_saved", buckets=4)
    rows = job.run(spark, [root], f"{tmp_path}/out").count()
    assert saved.count() == rows
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        first = spark.table("tessera_saved_pairs").join(spark.table("tessera_saved_buildings").drop("geometry").hint("merge"), "building_oid")
        assert "Exchange" not in first._jdf.queryExecution().executedPlan().toString()
        whole = job.saved_result(spark, "tessera_saved")._jdf.queryExecution().executedPlan().toString()
        assert whole.count("Exchange") == 1 and "hashpartitioning(flur_oid" in whole
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        for t in ("buildings", "parcels", "pairs"):
            spark.sql(f"DROP TABLE IF EXISTS tessera_saved_{t}")


def test_loads_take_new_and_changed_files(spark, tmp_path):
    def deliver(county, n):
        write_shapefile(f"{tmp_path}/in/{county}/L", [box(i, 0) for i in range(n)], {"oid": pa.array([f"{county}{i}" for i in range(n)])})

    def read(paths):
        return spark.read.format("shp").option("files", "\n".join(paths)).load()

    def now():
        return sorted((r.oid, r.load) for r in loaded(spark, target).collect())

    pattern, target = f"{tmp_path}/in/*/L.shp", f"{tmp_path}/table"
    deliver("a", 2)
    deliver("b", 1)
    assert load_new(spark, pattern, target, read) == 2 and now() == [("a0", 1), ("a1", 1), ("b0", 1)]
    assert load_new(spark, pattern, target, read) == 0
    deliver("c", 1)
    deliver("b", 3)

    def broken(paths):
        read(paths).write.parquet(f"{target}/data/load=2")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        load_new(spark, pattern, target, broken)
    assert now() == [("a0", 1), ("a1", 1), ("b0", 1)]  # what the failed load left is not read
    assert load_new(spark, pattern, target, read) == 2
    assert now() == [("a0", 1), ("a1", 1), ("b0", 2), ("b1", 2), ("b2", 2), ("c0", 2)]
    assert manifest(spark, target).count() == 4


# --- joins

@pytest.mark.parametrize("bad", [float("inf"), float("-inf"), float("nan")])
def test_coordinates_that_are_not_finite_are_named(spark, bad):
    schema = "id int, bbox struct<minx:double,miny:double,maxx:double,maxy:double>, geometry binary"
    left = spark.createDataFrame([(1, (0.0, 0.0, 1.0, 1.0), box(0, 0)), (2, (0.0, 0.0, bad, 1.0), box(0, 0))], schema)
    right = spark.createDataFrame([(1, (0.0, 0.0, 1.0, 1.0), box(0, 0))], schema)
    with pytest.raises(ValueError, match="1 features of the left layer have coordinates that are not finite"):
        spatial_join(left, right).count()
    with pytest.raises(ValueError, match="right layer"):
        overlay(right, left)


def test_names_stay_unique(spark, tmp_path):
    left = spark.createDataFrame([(1, 2, box(0, 0))], "id int, id_1 int, geometry binary")
    right = spark.createDataFrame([(3, 4, box(0, 0))], "id int, id_2 int, geometry binary")
    out = overlay(left, right)
    assert out.columns == ["id_1_1", "id_1", "id_2_2", "id_2", "geometry"]
    out.write.parquet(f"{tmp_path}/out")
    r = out.first()
    assert (r.id_1_1, r.id_1, r.id_2_2, r.id_2) == (1, 2, 3, 4)
