"""Cut features, the packed index and layers saved by county against the plain overlay."""

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.functions import st_area, wkb
from tessera.functions.wkb import Shape, box_ring
from tessera.operators.overlay import overlay
from tessera.operators.packed_index import PackedBoxes, hilbert, overlay_indexed
from tessera.operators.subdivide import overlay_subdivided, subdivide
from tessera.plans import fixtures as fx
from tessera.plans import job


def star(rng, x, y, size, n=9):
    a = (np.arange(n) + rng.uniform(0, 0.9, n)) * 2 * np.pi / n  # no gap of half a turn: the ring never crosses itself
    r = rng.uniform(0.4, 1, n) * size
    ring = np.c_[x + r * np.cos(a), y + r * np.sin(a)]
    return np.vstack([ring, ring[:1]])


@pytest.fixture(scope="module")
def layers(spark):
    rng = np.random.default_rng(11)
    small = [(i, "s", wkb.encode(Shape(polygons=[[star(rng, *rng.uniform(0, 100, 2), 3)]]))) for i in range(200)]
    large = [(i, "l", wkb.encode(Shape(polygons=[[star(rng, *rng.uniform(20, 80, 2), 60, 25)]]))) for i in range(4)]
    large += [(50, None, wkb.encode(Shape(polygons=[[box_ring(0, 0, 100, 100), box_ring(20, 20, 80, 80)[::-1]]]))), (51, "null", None),
              (52, "two", wkb.encode(Shape(polygons=[[box_ring(0, 0, 40, 40)], [box_ring(60, 60, 99, 99)]])))]
    schema = "id long, kind string, geometry binary"
    return spark.createDataFrame(small + [(300, "null", None)], schema).repartition(4), spark.createDataFrame(large, schema).repartition(2)


def areas(df):
    return {(r.id_1, r.id_2, r.kind_1, r.kind_2): r.a for r in df.select("*", st_area("geometry").alias("a")).collect()}


@pytest.mark.parametrize("size", [5.0, 17.0, 1000.0])
def test_cut_features_give_the_plain_overlay(layers, size):
    small, large = layers
    want = areas(overlay(small, large))
    got = areas(overlay_subdivided(small, large, piece_size=size))
    assert got.keys() == want.keys() and len(want) > 150
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9) for k in want)
    both = areas(overlay_subdivided(large, large, piece_size=size))
    plain = areas(overlay(large, large))
    assert {k for k, a in both.items() if a > 1e-6} == {k for k, a in plain.items() if a > 1e-6}
    assert all(both[k] == pytest.approx(plain[k], rel=1e-6) for k in both if both[k] > 1e-6)


def test_pieces_hold_the_outline_once(spark):
    """What is shuffled for a feature over many cells is its own bytes and the cuts, not a copy a cell."""
    n = 20_000
    a = np.linspace(0, 2 * np.pi, n + 1)
    ring = np.c_[500 + 400 * np.cos(a), 500 + 400 * np.sin(a)]
    ring[-1] = ring[0]
    whole = wkb.encode(Shape(polygons=[[ring]]))
    pieces = subdivide(spark.createDataFrame([(1, whole), (2, wkb.encode(Shape(polygons=[[box_ring(0, 0, 1, 1)]])))], "id int, geometry binary"), "id", 50.0)
    rows = pieces.select("id", "cut", F.length("geometry").alias("n"), st_area("geometry").alias("a")).collect()
    mine = [r for r in rows if r.id == 1]
    assert [(r.cut, r.a) for r in rows if r.id == 2] == [(False, 1.0)]
    assert len(mine) > 150 and all(r.cut for r in mine)
    assert sum(r.n for r in mine) < 1.3 * len(whole) and max(r.n for r in mine) < len(whole) / 10
    assert sum(r.a for r in mine) == pytest.approx(np.pi * 400**2, rel=1e-4)


def test_hilbert_neighbours_lie_side_by_side():
    k = 16
    x, y = (v.ravel() / (k - 1) for v in np.meshgrid(np.arange(k), np.arange(k)))
    order = np.argsort(hilbert(x, y, 4))
    step = np.abs(np.diff(x[order])) + np.abs(np.diff(y[order]))
    assert len(set(hilbert(x, y, 4).tolist())) == k * k and np.allclose(step, 1 / (k - 1))


@pytest.mark.parametrize("n", [0, 1, 16, 17, 700])
def test_packed_boxes_against_all_pairs(n):
    rng = np.random.default_rng(n)
    low = rng.integers(0, 60, (n, 2)).astype(float)
    boxes = np.hstack([low, low + rng.integers(0, 9, (n, 2))])
    ask = np.vstack([np.c_[rng.integers(0, 60, (40, 2)), np.zeros((40, 2))], [[-5, -5, -1, -1], [0, 0, 99, 99], [np.nan] * 4]])
    ask[:40, 2:] = ask[:40, :2] + rng.integers(0, 5, (40, 2))
    want = {(i, j) for i, a in enumerate(ask) for j, b in enumerate(boxes) if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]}
    q, item = PackedBoxes(boxes).meeting(ask)
    assert sorted(zip(q.tolist(), item.tolist(), strict=True)) == sorted(want)


def test_indexed_overlay_is_the_plain_one(spark, layers):
    small, large = layers
    want = areas(overlay(small, large))
    got = overlay_indexed(small, large, max_broadcast_bytes=1 << 20, pairs_at_once=7)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "").split("MapInArrow")[0]
    assert areas(got) == pytest.approx(want)
    touching = overlay_indexed(small, small, max_broadcast_bytes=1 << 20, keep_geom_type=False)
    assert touching.count() == overlay(small, small, keep_geom_type=False).count()
    assert overlay_indexed(small, large.where("id < 0"), max_broadcast_bytes=1 << 20).count() == 0


def test_a_side_beyond_the_limit_takes_the_grid_join(layers):
    small, large = layers
    for limit in (0, 200, 1500):
        got = overlay_indexed(small, large, max_broadcast_bytes=limit)
        assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert areas(got) == pytest.approx(areas(overlay(small, large)))


def test_counties_are_pruned_at_run_time(spark, tmp_path):
    b = job.save_by_county(fx.buildings_counties(spark, SF_SMALL).select(F.col("building_oid").alias("oid"), "geometry", "bbox", "county"), f"{tmp_path}/b")
    p = job.save_by_county(fx.parcels_counties(spark, SF_SMALL, None).select(F.col("parcel_oid").alias("oid"), "geometry", "bbox", "county"), f"{tmp_path}/p")
    wanted = spark.read.parquet(f"{SF_SMALL}/region.parquet").where("r_name = 'ASIA'").select(F.col("r_regionkey").cast("int").alias("county"))
    out = job.overlay_counties(b, p, wanted)
    assert "dynamicpruning" in out._jdf.queryExecution().executedPlan().toString()
    assert {r.county for r in out.select("county").distinct().collect()} == {2}
    plain = job.overlay_layers(b.where("county = 2"), p.where("county = 2"), county_wise=True)
    assert out.count() == plain.count() > 0


def test_hot_cells_are_counted_by_county(spark):
    """All features in one cell: split county by county, the same pairs."""
    b = fx.buildings_counties(spark, SF_SMALL).select("building_oid", "geometry", "bbox", "county")
    p = fx.parcels_counties(spark, SF_SMALL, None).select("parcel_oid", "geometry", "bbox", "county")
    split = overlay(b, p, partition_by=["county"], hot_cell_rows=20, cell_size=5000.0)
    plain = overlay(b, p, partition_by=["county"], salt_hot_cells=False)
    key = lambda df: sorted((r.building_oid, r.parcel_oid, r.county) for r in df.collect())
    assert key(split) == key(plain)


def test_sql_join_has_levels_and_one_clip(spark, layers):
    """Large and small features in SQL: the rows of the plain join, no nested loop or broadcast, one clip a pair."""
    from tessera.functions import st_bbox
    from tessera.operators.spatial_join import spatial_join, spatial_join_sql
    from tessera.session import register

    register(spark)
    for name, df in zip(("sql_small", "sql_large"), layers, strict=True):
        df.withColumn("bbox", st_bbox("geometry")).createOrReplaceTempView(name)
    key = lambda df: sorted(map(tuple, df.collect()))
    plain = key(spatial_join(*layers).select("id_1", "id_2"))
    for cells in (9, 1024):
        got = spatial_join_sql(spark, "sql_small", "sql_large", "a.id, b.id AS other", max_cells=cells)
        assert key(got) == plain
    clipped = spatial_join_sql(spark, "sql_small", "sql_large", "a.id, b.id AS other, st_area(shared) AS area", clip="shared", where="a.id < 100")
    plan = clipped._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert plan.count("st_clip_once(") == 1
    want = {(a, b): x for (a, b, _, _), x in areas(overlay(*layers)).items() if a < 100}
    assert {(r.id, r.other): r.area for r in clipped.collect()} == pytest.approx(want)
