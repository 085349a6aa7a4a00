"""Spatial join on ``ST_Intersects`` expressed as an ordinary equi-join.

Catalyst plans a join on a geometry predicate as a nested loop or a
Cartesian product.  Here each row is assigned the grid cells its bounding
box covers and the two sides are joined on the cell key, so Spark can use a
shuffled or broadcast hash join and adaptive skew handling as usual:

1. ``bbox`` per row (taken from the input when present, else computed once).
2. Cell size ``c``: twice the median feature extent of the side with larger
   features (one aggregate per side), or given by the caller.
3. Multi-level grid: a row whose box would cover more than ``max_cells``
   cells of size ``c`` is placed on level ``L`` with cells of size
   ``c * 2**L`` instead.  A pair is matched on the coarser of its two levels,
   so small rows are also keyed on the coarse levels present on the other
   side.  No row is ever dropped or capped.
4. Equi-join on ``(level, cx, cy[, partition keys][, salt])`` plus a closed
   bounding-box overlap test.
5. Reference-point rule: a pair is kept only in the cell holding
   ``(max(minx), max(miny))`` of the two boxes, so each pair appears exactly
   once without a ``distinct``.
6. Hot cells (optional, on by default): cells holding more rows than a
   threshold are split into salt buckets on the larger side and the other
   side's rows of that cell are replicated into every bucket.

The exact geometry predicate or clip runs afterwards on the surviving pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bbox_of, st_bbox, st_intersects
from ..functions import columns as fc
from ..session import written

BBOX = "bbox"
_L, _R = "__l", "__r"


@dataclass
class GridPlan:
    """Driver-side decisions for one join (all derived from small aggregates)."""

    cell_size: float
    per_axis: int
    levels_left: list = field(default_factory=lambda: [0])
    levels_right: list = field(default_factory=lambda: [0])
    rows_left: int = 0
    rows_right: int = 0
    broadcast_side: str | None = None
    hot_cells: int = 0


def with_bbox(df: DataFrame, geometry: str = "geometry", bbox: str = BBOX) -> DataFrame:
    """Add the bounding-box struct column unless it is already there."""
    if bbox in df.columns:
        return df
    return df.withColumn(bbox, st_bbox(geometry))


def _extent(b: Column) -> Column:
    return F.greatest(b["maxx"] - b["minx"], b["maxy"] - b["miny"])


def _thresholds(cell: float, per_axis: int, max_level: int) -> list:
    """Level ``j`` holds extents up to ``cell * (per_axis - 2) * 2**j`` (exact doubles)."""
    lim = cell * (per_axis - 2)
    return [lim * (2.0 ** j) for j in range(max_level)]


def _level_expr(b: Column, thresholds: list) -> Column:
    """Level of a row by exact comparisons (no floating log), identical on driver and executors."""
    ext = _extent(b)
    expr = F.lit(len(thresholds))
    for j in reversed(range(len(thresholds))):
        expr = F.when(ext <= F.lit(thresholds[j]), F.lit(j)).otherwise(expr)
    return expr.cast("int")


def _level_py(ext: float, thresholds: list) -> int:
    for j, t in enumerate(thresholds):
        if ext <= t:
            return j
    return len(thresholds)


def _exponent(ext: Column) -> Column:
    """``floor(log2(ext))`` corrected to be exact (the floating log may be off by one)."""
    e = F.floor(F.log2(F.when(ext > 0, ext)))
    e = F.when(F.pow(F.lit(2.0), e) > ext, e - 1).otherwise(e)
    return F.when(F.pow(F.lit(2.0), e + 1) <= ext, e + 1).otherwise(e)


def _stats_both(left: DataFrame, right: DataFrame, bbox: str) -> tuple[dict, dict]:
    """Per side: row count, median and largest extent.

    One aggregate job over the two bounding-box columns only (partial
    aggregation on the map side, one row per side reaches the driver)."""
    slim = (left.select(F.lit(0).alias("side"), F.col(bbox).alias("b"))
            .unionByName(right.select(F.lit(1).alias("side"), F.col(bbox).alias("b")))
            .where(F.col("b").isNotNull()))
    ext = _extent(F.col("b"))
    finite = reduce(lambda x, y: x & y, (F.abs(F.col("b")[k]) < F.lit(math.inf) for k in ("minx", "miny", "maxx", "maxy")))  # NaN is above infinity
    rows = {r["side"]: r for r in slim.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~finite).alias("unbounded"),
        F.percentile_approx(ext, 0.5, 1000).alias("med"),
        F.max(ext).alias("top"),
    ).collect()}
    for side, r in rows.items():
        if r["unbounded"]:
            raise ValueError(f"{r['unbounded']} features of the {('left', 'right')[side]} layer have coordinates that are not finite")
    out = []
    for side in (0, 1):
        r = rows.get(side)
        if r is None:
            out.append({"n": 0, "med": 0.0, "top": 0.0})
        else:
            out.append({"n": int(r["n"]), "med": float(r["med"] or 0.0), "top": float(r["top"] or 0.0)})
    return out[0], out[1]


def _max_level(top: float, cell: float, per_axis: int) -> int:
    """Number of thresholds needed so the largest extent gets a level."""
    lim = cell * (per_axis - 2)
    j = 0
    while lim * (2.0 ** j) < top:
        j += 1
    return j


def _exact_levels(df: DataFrame, bbox: str, thresholds: list) -> list:
    """Second small aggregate, only run when oversize rows may exist."""
    rows = df.where(F.col(bbox).isNotNull()).agg(
        F.collect_set(_level_expr(F.col(bbox), thresholds)).alias("lv")).first()
    return sorted(set(int(v) for v in rows["lv"]) | {0})


def _default_max_broadcast(spark) -> int:
    """Spark's own limit; -1 (broadcast off) allows none."""
    return max(0, int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()))


def _explode_cells(df: DataFrame, bbox: Column, own_levels: list, other_levels: list,
                   cell: float, thresholds: list, prefix: str) -> DataFrame:
    lvl_name, cx, cy, own = f"{prefix}lvl", f"{prefix}cx", f"{prefix}cy", f"{prefix}own"
    if own_levels == [0] and other_levels == [0]:
        df = df.withColumn(own, F.lit(0)).withColumn(lvl_name, F.lit(0))
    else:
        df = df.withColumn(own, _level_expr(bbox, thresholds))
        higher = sorted(set(other_levels))
        own_col = F.col(own)
        lvls = F.concat(F.array(own_col), F.filter(F.array(*[F.lit(j) for j in higher]), lambda x: x > own_col))
        df = df.withColumn(lvl_name, F.explode(F.array_distinct(lvls)))
    size = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col(lvl_name))
    x0 = F.floor(bbox["minx"] / size)
    x1 = F.floor(bbox["maxx"] / size)
    y0 = F.floor(bbox["miny"] / size)
    y1 = F.floor(bbox["maxy"] / size)
    return (df.withColumn(cx, F.explode(F.sequence(x0, x1)))
              .withColumn(cy, F.explode(F.sequence(y0, y1))))


def _hot_cells(lx: DataFrame, rx: DataFrame, rows: int, lkeys: list, rkeys: list) -> DataFrame:
    """Cells (of one county, say, with partition keys) whose candidate pairs exceed ``rows ** 2``, with the number of
    parts of each side."""
    names = [f"__hot_{i}" for i in range(len(lkeys))]

    def count(df, keys, n):
        return df.groupBy(*[F.col(k).alias(name) for k, name in zip(keys, names)]).agg(F.count("*").alias(n))

    both = count(lx, lkeys, "nl").join(count(rx, rkeys, "nr"), names)
    return (both.where(F.col("nl").cast("double") * F.col("nr") > float(rows) ** 2)
            .select(*names, F.ceil(F.col("nl") / rows).alias("__hot_s"), F.ceil(F.col("nr") / rows).alias("__hot_t")))


def _salted(df: DataFrame, hot: DataFrame, small: bool, keys: list, prefix: str, left: bool, basis: Column) -> DataFrame:
    """Deal a hot cell's rows over s x t buckets: a row has one part of its own side and meets all parts of the other."""
    h = F.broadcast(hot) if small else hot.hint("merge")
    j = df.join(h, [df[k] == hot[f"__hot_{i}"] for i, k in enumerate(keys)], "left")
    s, t = F.col("__hot_s"), F.col("__hot_t")
    own = F.pmod(F.xxhash64(basis), s if left else t)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), (t if left else s) - 1), lambda o: own * t + o if left else o * t + own)
    salts = F.when(s.isNull(), F.array(F.lit(0).cast("long"))).otherwise(meets)
    return j.withColumn(f"{prefix}salt", F.explode(salts)).drop(*hot.columns)


def candidate_pairs(
    left: DataFrame,
    right: DataFrame,
    *,
    left_geometry: str = "geometry",
    right_geometry: str = "geometry",
    cell_size: float | None = None,
    max_cells: int = 1024,
    partition_by: list | None = None,
    broadcast: str | None = None,
    max_broadcast_bytes: int | None = None,
    hot_cell_rows: int = 20_000,
    salt_hot_cells: bool = True,
    npartitions: int | None = None,
) -> tuple[DataFrame, GridPlan]:
    """Pairs whose bounding boxes meet (touching counts), each exactly once.

    Returns a DataFrame with struct columns ``__l`` and ``__r`` holding the
    rows of each side (their ``bbox`` included), and the plan used.
    """
    spark = left.sparkSession
    partition_by = list(partition_by or [])
    L = with_bbox(left, left_geometry)
    R = with_bbox(right, right_geometry)
    L = L.where(F.col(BBOX).isNotNull())
    R = R.where(F.col(BBOX).isNotNull())

    sl, sr = _stats_both(L, R, BBOX)
    per_axis = max(3, int(math.isqrt(max(int(max_cells), 9))))
    if cell_size is None:
        med = max(sl["med"], sr["med"])
        cell_size = 2.0 * med if med > 0 else 1.0
    cell = float(cell_size)
    thresholds = _thresholds(cell, per_axis, _max_level(max(sl["top"], sr["top"]), cell, per_axis))
    plan = GridPlan(cell_size=cell, per_axis=per_axis, rows_left=sl["n"], rows_right=sr["n"])
    if _level_py(sl["top"], thresholds) > 0 or _level_py(sr["top"], thresholds) > 0:
        # oversize rows exist: one more small aggregate gives the exact level sets
        plan.levels_left = _exact_levels(L, BBOX, thresholds)
        plan.levels_right = _exact_levels(R, BBOX, thresholds)

    lcols, rcols = L.columns, R.columns
    lpay = L.select(F.struct(*[F.col(c) for c in lcols]).alias(_L), *[F.col(k).alias(f"__lk_{k}") for k in partition_by])
    rpay = R.select(F.struct(*[F.col(c) for c in rcols]).alias(_R), *[F.col(k).alias(f"__rk_{k}") for k in partition_by])
    lb, rb = F.col(f"{_L}.{BBOX}"), F.col(f"{_R}.{BBOX}")
    lx = _explode_cells(lpay, lb, plan.levels_left, plan.levels_right, cell, thresholds, "__l_")
    rx = _explode_cells(rpay, rb, plan.levels_right, plan.levels_left, cell, thresholds, "__r_")

    lkeys = ["__l_lvl", "__l_cx", "__l_cy"] + [f"__lk_{k}" for k in partition_by]
    rkeys = ["__r_lvl", "__r_cx", "__r_cy"] + [f"__rk_{k}" for k in partition_by]

    # ---- hot cells: both sides are split, so a bucket holds at most about hot_cell_rows of each
    if salt_hot_cells and plan.rows_left * plan.rows_right > hot_cell_rows**2:
        slim_l, slim_r = (
            _explode_cells(df.select(F.col(BBOX).alias("__b"), *[F.col(k).alias(f"{p[:3]}k_{k}") for k in partition_by]), F.col("__b"), own, other, cell, thresholds, p)
            for df, own, other, p in ((L, plan.levels_left, plan.levels_right, "__l_"), (R, plan.levels_right, plan.levels_left, "__r_")))
        hot = written(_hot_cells(slim_l, slim_r, hot_cell_rows, lkeys, rkeys), "hot-cells")  # counted once, read three times
        plan.hot_cells = hot.count()
        if plan.hot_cells:
            small = plan.hot_cells <= 100_000  # 40 bytes a cell
            lx = _salted(lx, hot, small, lkeys, "__l_", True, F.col(_L))
            rx = _salted(rx, hot, small, rkeys, "__r_", False, F.col(_R))
            lkeys.append("__l_salt")
            rkeys.append("__r_salt")

    # ---- broadcast only behind a size check
    if broadcast in ("left", "right"):
        limit = max_broadcast_bytes if max_broadcast_bytes is not None else _default_max_broadcast(spark)
        side = R if broadcast == "right" else L
        geom = right_geometry if broadcast == "right" else left_geometry
        own, other = (plan.levels_right, plan.levels_left) if broadcast == "right" else (plan.levels_left, plan.levels_right)
        # the rows that would be sent: each feature once a cell
        cells = _explode_cells(side.select(F.length(geom).alias("__n"), F.col(BBOX).alias("__b")), F.col("__b"), own, other, cell, thresholds, "__s_")
        est = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("__n").alias("b")).first()
        width = 64 * len(side.columns)
        size = int(est["b"] or 0) + int(est["n"] or 0) * width
        if size <= limit:
            plan.broadcast_side = broadcast
            if broadcast == "right":
                rx = F.broadcast(rx)
            else:
                lx = F.broadcast(lx)

    if plan.broadcast_side is None:
        # sort-merge join on the cell key: no unchecked broadcast of exploded rows (Spark's size
        # estimate of a generator's output is a guess), and AQE can split skewed cells
        lx = lx.hint("merge")
    else:
        # the streamed side is split evenly so the clip kernel runs on every core
        n = npartitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        if plan.broadcast_side == "right":
            lx = lx.repartition(n)
        else:
            rx = rx.repartition(n)
    cond = [lx[a] == rx[b] for a, b in zip(lkeys, rkeys)]
    joined = lx.join(rx, cond, "inner")
    lvl = F.col("__l_lvl")
    size = F.lit(cell) * F.pow(F.lit(2.0), lvl)
    refx = F.greatest(lb["minx"], rb["minx"])
    refy = F.greatest(lb["miny"], rb["miny"])
    keep = (
        (lvl == F.greatest(F.col("__l_own"), F.col("__r_own")))
        & (lb["minx"] <= rb["maxx"]) & (rb["minx"] <= lb["maxx"])
        & (lb["miny"] <= rb["maxy"]) & (rb["miny"] <= lb["maxy"])
        & (F.floor(refx / size) == F.col("__l_cx"))
        & (F.floor(refy / size) == F.col("__l_cy"))
    )
    pairs = joined.where(keep).select(_L, _R)
    return pairs, plan


def _flatten(pairs: DataFrame, left_cols: list, right_cols: list, suffixes=("_1", "_2"),
             prefixes: tuple | None = None, drop_right: tuple = ()) -> list:
    """Column list for ``select``: both attribute sets, collisions told apart.  A name that a suffix or prefix would make
    twice gets the suffix again."""
    right_cols = [c for c in right_cols if c not in drop_right]
    shared = set(left_cols) & set(right_cols)
    wanted = []
    for side, cols, k in ((_L, left_cols, 0), (_R, right_cols, 1)):
        for c in cols:
            wanted.append((side, c, f"{prefixes[k]}{c}" if prefixes else c + suffixes[k] if c in shared else c, suffixes[k]))
    taken = {name for _, c, name, _ in wanted if name == c}  # names that columns have of their own stay theirs
    out = []
    for side, c, name, suffix in wanted:
        while name != c and name in taken:
            name += suffix
        taken.add(name)
        out.append(F.col(f"{side}.`{c}`").alias(name))
    return out


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_geometry: str = "geometry",
    right_geometry: str = "geometry",
    suffixes=("_1", "_2"),
    partition_by: list | None = None,
    **grid,
) -> DataFrame:
    """Inner join on ``ST_Intersects`` (boundary contact counts as a match).

    Output: every left column, then every right column (input ``bbox`` columns
    dropped); names present on both sides get ``suffixes``.
    """
    pairs, _ = candidate_pairs(left, right, left_geometry=left_geometry, right_geometry=right_geometry,
                               partition_by=partition_by, **grid)
    hit = pairs.where(st_intersects(F.col(f"{_L}.{left_geometry}"), F.col(f"{_R}.{right_geometry}")))
    lcols = [c for c in left.columns if c != BBOX]
    rcols = [c for c in right.columns if c != BBOX]
    return hit.select(*_flatten(hit, lcols, rcols, suffixes, drop_right=tuple(partition_by or ())))


__all__ = ["GridPlan", "bbox_of", "candidate_pairs", "spatial_join", "with_bbox"]


def spatial_join_sql(spark, left_view: str, right_view: str, select: str, cell_size: float | None = None,
                     left_geometry: str = "geometry", right_geometry: str = "geometry",
                     clip: str | None = None, where: str | None = None, max_cells: int = 1024):
    """The grid join written as Spark SQL over two views that have a ``bbox`` column.

    ``select`` is the projection over aliases ``a`` (left) and ``b`` (right);
    ``st_intersects`` must be registered (``tessera.register``).  ``clip`` names
    a column with the polygonal part of the shared geometry: it is made once a
    pair, replaces the test and is there for ``select`` and ``where``.  Levels are
    those of ``candidate_pairs``: a very large feature is keyed on coarser cells.
    """
    sides = [spark.table(v) for v in (left_view, right_view)]
    stats = _stats_both(*sides, BBOX)
    c = float(cell_size) if cell_size else 2.0 * max(s["med"] for s in stats) or 1.0
    per_axis = max(3, math.isqrt(max(int(max_cells), 9)))
    thresholds = _thresholds(c, per_axis, _max_level(max(s["top"] for s in stats), c, per_axis))
    levels = sorted({x for df in sides for x in _exact_levels(df, BBOX, thresholds)}) if thresholds else [0]
    extent = "greatest(t.bbox.maxx - t.bbox.minx, t.bbox.maxy - t.bbox.miny)"
    own = "CASE " + " ".join(f"WHEN {extent} <= {t!r}D THEN {j}" for j, t in enumerate(thresholds)) + f" ELSE {len(thresholds)} END" if thresholds else "0"
    coarser = f"filter(array({', '.join(map(str, levels))}), x -> x >= own)"

    def cells(view: str) -> str:
        cover = lambda low, high: f"explode(sequence(CAST(floor({low} / ({c!r}D * power(2, lvl))) AS BIGINT), CAST(floor({high} / ({c!r}D * power(2, lvl))) AS BIGINT)))"
        return (f"SELECT o.*, lvl, cx, cy FROM (SELECT t.*, {own} AS own FROM {view} t WHERE t.bbox IS NOT NULL) o "
                f"LATERAL VIEW explode({coarser}) el AS lvl "
                f"LATERAL VIEW {cover('o.bbox.minx', 'o.bbox.maxx')} ex AS cx "
                f"LATERAL VIEW {cover('o.bbox.miny', 'o.bbox.maxy')} ey AS cy")

    size = f"({c!r}D * power(2, a.lvl))"
    pairs = f"""SELECT /*+ MERGE(a, b) */ struct(a.*) AS a, struct(b.*) AS b
        FROM ({cells(left_view)}) a
        JOIN ({cells(right_view)}) b ON a.lvl = b.lvl AND a.cx = b.cx AND a.cy = b.cy
        WHERE a.lvl = greatest(a.own, b.own)
          AND a.bbox.minx <= b.bbox.maxx AND b.bbox.minx <= a.bbox.maxx
          AND a.bbox.miny <= b.bbox.maxy AND b.bbox.miny <= a.bbox.maxy
          AND CAST(floor(greatest(a.bbox.minx, b.bbox.minx) / {size}) AS BIGINT) = a.cx
          AND CAST(floor(greatest(a.bbox.miny, b.bbox.miny) / {size}) AS BIGINT) = a.cy"""
    if clip:
        spark.udf.register("st_clip_once", fc._clip_udf.asNondeterministic())  # evaluated once, whatever uses its column
        inner = f"SELECT *, st_clip_once(a.{left_geometry}, b.{right_geometry}) AS {clip} FROM ({pairs})"
        test = f"{clip} IS NOT NULL"
    else:
        inner, test = pairs, f"st_intersects(a.{left_geometry}, b.{right_geometry})"
    return spark.sql(f"SELECT {select} FROM ({inner}) WHERE {test} {'AND ' + where if where else ''}")


def choose_cell_size(left: DataFrame, right: DataFrame, left_geometry: str = "geometry",
                     right_geometry: str = "geometry") -> float:
    """Twice the larger of the two median feature extents (two small aggregates)."""
    sl, sr = _stats_both(with_bbox(left, left_geometry), with_bbox(right, right_geometry), BBOX)
    med = max(sl["med"], sr["med"])
    return 2.0 * med if med > 0 else 1.0
