"""Grid join equals a brute-force theta join, including oversize rows and salted cells."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import bbox_of, st_make_envelope
from tessera.operators.spatial_join import candidate_pairs, spatial_join


def _boxes(spark, n, seed, big=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rnd.uniform(0, 100), rnd.uniform(0, 100)
        w, h = rnd.uniform(0.5, 4), rnd.uniform(0.5, 4)
        if i < big:
            w, h = rnd.uniform(60, 300), rnd.uniform(60, 300)
        rows.append((i, float(round(x)), float(round(y)), float(round(x + w)), float(round(y + h))))
    df = spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double")
    return df.select("id", st_make_envelope("x0", "y0", "x1", "y1").alias("geometry"),
                     bbox_of("x0", "y0", "x1", "y1").alias("bbox")), rows


def _brute(a, b):
    return sorted((i, j) for i, ax0, ay0, ax1, ay1 in a for j, bx0, by0, bx1, by1 in b
                  if ax0 <= bx1 and bx0 <= ax1 and ay0 <= by1 and by0 <= ay1)


@pytest.mark.parametrize("kw", [{}, {"max_cells": 16}, {"hot_cell_rows": 5}, {"broadcast": "right"},
                                {"cell_size": 0.7}])
def test_grid_join_equals_theta_join(spark, kw):
    left, lrows = _boxes(spark, 300, 1, big=3)
    right, rrows = _boxes(spark, 200, 2, big=2)
    pairs, plan = candidate_pairs(left, right, **kw)
    got = sorted((r[0], r[1]) for r in pairs.select("__l.id", "__r.id").collect())
    assert got == _brute(lrows, rrows)
    if kw.get("max_cells") == 16:
        assert plan.levels_left != [0] or plan.levels_right != [0]
    if "hot_cell_rows" in kw:
        assert plan.hot_cells > 0


def test_spatial_join_columns_and_suffixes(spark):
    left, _ = _boxes(spark, 50, 3)
    right, _ = _boxes(spark, 50, 4)
    j = spatial_join(left, right)
    assert j.columns == ["id_1", "geometry_1", "id_2", "geometry_2"]


def test_plan_is_an_equi_join(spark):
    left, _ = _boxes(spark, 50, 5)
    right, _ = _boxes(spark, 50, 6)
    pairs, _ = candidate_pairs(left, right)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "SortMergeJoin" in plan or "BroadcastHashJoin" in plan or "ShuffledHashJoin" in plan
