"""The whole overlay job: per-county shapefiles in, location-ordered GeoParquet out.

``read layers -> keep-first dedup by oid -> repair -> intersection overlay ->
geohash / grid hash -> range-partitioned sort -> GeoParquet``.  Each source
is decoded once: the layers as read and as prepared are written to the shared
``spark.checkpoint.dir``, the grid join plans on their bbox, and the result goes
from the clip to its ordered files without a copy in between.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import st_bbox, st_geohash, st_grid_hash
from ..functions.hashing import GEOHASH_ALPHABET
from ..operators.dedup import drop_duplicates_any, drop_duplicates_first
from ..operators.overlay import overlay
from ..operators.repair import repair
from ..session import written
from ..sources import fs

# Layer file names and attribute lists of the reference job.
BUILDINGS_LAYER = "GebauedeBauwerk"
PARCELS_LAYER = "NutzungFlurstueck"
BUILDING_COLUMNS = ["oid", "gebnutzbez", "gfkzshh", "name", "anzahlgs", "gmdschl", "lagebeztxt", "funktion"]
PARCEL_COLUMNS = ["oid", "nutzart", "bez", "flstkennz"]
RESULT_COLUMNS = ["building_oid", "gebnutzbez", "gfkzshh", "name", "anzahlgs", "gmdschl", "lagebeztxt",
                  "funktion", "flur_oid", "nutzart", "bez", "flstkennz"]
ETRS89_UTM33N = "EPSG:25833"
#: Cell of the result's location order, in metres.
LOCATION_CELL = 1000.0


def resolve_root(candidates: list, layer: str = BUILDINGS_LAYER) -> str:
    """First candidate root that holds ``*/<layer>.shp``; ``FileNotFoundError`` if none does."""
    for root in candidates:
        if fs.expand(f"{root.rstrip('/')}/*/{layer}.shp"):
            return root
    raise FileNotFoundError(f"no data directory with {layer} files among {candidates}")


def layer_paths(root: str) -> tuple[str, str]:
    """Glob patterns of both layers; error when either layer has no file."""
    b = f"{root.rstrip('/')}/*/{BUILDINGS_LAYER}.shp"
    p = f"{root.rstrip('/')}/*/{PARCELS_LAYER}.shp"
    if not fs.expand(b) or not fs.expand(p):
        raise FileNotFoundError(f"missing building or parcel shapefiles under {root}")
    return b, p


def read_layer(spark: SparkSession, pattern: str, columns: list | None = None, *, paired_with: str | None = None,
               geometry: bool = True) -> DataFrame:
    """A layer's shapefiles; ``paired_with``: only of folders that hold a file of that pattern, too (a listing
    tells, no file is opened for it)."""
    r = spark.read.format("shp").option("geometry", str(geometry).lower())
    if columns:
        r = r.option("columns", ",".join(columns))
    if paired_with:
        r = r.option("pairedWith", paired_with)
    return r.load(pattern)


def counted(df: DataFrame, counts: dict | None, name: str) -> DataFrame:
    """``df`` whose rows are counted while they pass; ``resolve`` puts the number into ``counts``."""
    if counts is None:
        return df
    counts[name] = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(counts[name], F.count(F.lit(1)).alias("rows"))


def resolve(counts: dict | None) -> None:
    """Numbers in place of the observations, once the jobs they sit in have run."""
    for name, seen in list((counts or {}).items()):
        if isinstance(seen, Observation):
            counts[name] = int(seen.get["rows"])


def paired_counties(buildings: DataFrame, parcels: DataFrame, key: str = "county") -> tuple[DataFrame, DataFrame]:
    """Keep only counties that have both layers (semi joins on the small county lists)."""
    bk = buildings.select(key).distinct()
    pk = parcels.select(key).distinct()
    return buildings.join(pk, key, "left_semi"), parcels.join(bk, key, "left_semi")


def prepare(df: DataFrame, columns: list | None, dedup: str = "first", repair_when: str | None = "all",
            key: str = "oid", counts: dict | None = None, name: str = "rows") -> DataFrame:
    """Project, dedup on ``key`` (``first`` in file order, ``any`` or ``none``), repair.

    ``counts`` gets what a layer loses on the way: ``<name>_kept`` rows, counted as they are written."""
    keep = list(dict.fromkeys([*(columns or [c for c in df.columns if c not in ("geometry", "bbox")]), "geometry", "bbox"]))
    keep = [c for c in keep if c in df.columns or c != "bbox"]
    order = ["source_file", "record_no"] if dedup == "first" else []
    df = df.select(*dict.fromkeys(keep + order))
    if dedup == "first":
        df = drop_duplicates_first(df, key)
    elif dedup == "any":
        df = drop_duplicates_any(df, key)
    if repair_when:
        df = repair(df)
    return counted(df.select(*keep), counts, f"{name}_kept")


def overlay_layers(buildings: DataFrame, parcels: DataFrame, *, county_wise: bool = False, **grid) -> DataFrame:
    """Intersection overlay with the reference's naming: ``building_oid`` / ``flur_oid``."""
    b = buildings.withColumnRenamed("oid", "building_oid")
    p = parcels.withColumnRenamed("oid", "flur_oid")
    return overlay(b, p, partition_by=["county"] if county_wise else None, **grid)


def with_location_keys(df: DataFrame, cell: float = LOCATION_CELL) -> DataFrame:
    """``geom_hash`` (5-char geohash, NULL for projected metres) and ``grid_hash`` (Z-order of a
    ``cell``-metre grid) from the result geometry's bounding box."""
    b = st_bbox("geometry")
    return (df.withColumn("__bb", b)
              .withColumn("geom_hash", st_geohash("__bb", 5))
              .withColumn("grid_hash", st_grid_hash("__bb", cell))
              .drop("__bb"))


def prepared(spark: SparkSession, path: str, make, refresh: bool = False) -> DataFrame:
    """The Parquet table at ``path``; made from ``make()`` if it is not there yet, or on ``refresh``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if refresh or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def location_key(geom_hash: str = "geom_hash", grid_hash: str = "grid_hash") -> Column:
    """A whole number that never falls along the order (geom_hash, grid_hash): 26 bits of geohash, the upper 27 of the grid's
    Z-order; 53 in all, which ``percentile_approx`` returns as they are."""
    letters = [F.expr(f"instr('{GEOHASH_ALPHABET}', substring({geom_hash}, {i}, 1)) - 1") for i in range(1, 6)]
    code = letters[0].cast("long")
    for x in letters[1:]:
        code = F.shiftleft(code, 5) + x
    high = F.when(F.col(geom_hash).isNull(), F.lit(0).cast("long")).otherwise(code + 1)
    return F.shiftleft(high, 27).bitwiseOR(F.shiftright(_grid_number(grid_hash), 14))


def _grid_number(grid_hash: str) -> Column:
    return F.coalesce(F.col(grid_hash) + 1, F.lit(0).cast("long"))


def place_in_key(number: Column, grid_hash: str = "grid_hash") -> Column:
    """The order of rows with the same ``location_key``: the lower bits of the grid's Z-order, then 39 bits of ``number``."""
    return F.shiftleft(_grid_number(grid_hash).bitwiseAND(F.lit(0x3FFF)), 39).bitwiseOR(number.bitwiseAND(F.lit((1 << 39) - 1)))


def location_ordered(df: DataFrame, single_file: bool = False, sample: DataFrame | None = None, ranges: int | None = None) -> DataFrame:
    """Global order by location: ranges of location keys, sorted inside (``single_file`` coalesces to one task).

    ``orderBy`` would run its input twice, once to sample it.  Here the splitters come from the location keys of
    ``sample``, a written table with ``geom_hash`` and ``grid_hash`` (a prepared layer: results lie where its features
    do), of which one aggregate reads those columns alone.  Each row is then dealt to its range as it is made: ``df`` is
    evaluated once and written nowhere in between.  Partition k holds no greater keys than partition k + 1: a key that fills
    several ranges is dealt over them by the rest of its order, and by its rows' hashes where that is equal, too.
    """
    if sample is None:
        df = sample = written(df, "overlay")
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = lambda m: [i / m for i in range(1, m)]
    cuts = sample.agg(F.percentile_approx(location_key(), share(n), 100 * n).alias("q")).first()["q"] if n > 1 else None
    splitters = np.sort(np.array(cuts or [], np.int64))
    keys, times = np.unique(splitters, return_counts=True)
    full = {k: m for k, m in zip(keys.tolist(), times.tolist(), strict=True) if m > 1}
    inner = {}
    if full:  # keys that fill several ranges: their rows' places in the key split them
        most = max(full.values())
        places = sample.select(location_key().alias("k"), place_in_key(F.xxhash64(F.monotonically_increasing_id())).alias("p")).where(F.col("k").isin(list(full)))
        for r in places.groupBy("k").agg(F.percentile_approx("p", share(most), 100 * most).alias("q")).collect():
            own = np.linspace(0, most, full[r["k"]], endpoint=False).round().astype(int)[1:] - 1
            inner[r["k"]] = np.array(r["q"], np.int64)[own]

    @F.arrow_udf("int")
    def range_of(key: pa.Array, place: pa.Array) -> pa.Array:
        key, place = (x.to_numpy(zero_copy_only=False) for x in (key, place))
        out = np.searchsorted(splitters, key, "left") + np.isin(key, splitters)
        for k in inner.keys() & set(np.unique(key).tolist()):
            own = key == k
            out[own] += np.searchsorted(inner[k], place[own], "right")
        return pa.array(out.astype(np.int32))

    of_row = F.xxhash64(*[f.name for f in df.schema if "map<" not in f.dataType.simpleString()])
    dealt = df.repartitionById(len(splitters) + 1, range_of(location_key(), place_in_key(of_row)))
    out = dealt.sortWithinPartitions("geom_hash", "grid_hash")
    return out.coalesce(1) if single_file else out


def save_by_county(df: DataFrame, path: str, key: str = "county") -> DataFrame:
    """A prepared layer as a table with a folder for each county; read back, filters on the county prune folders."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def overlay_counties(buildings: DataFrame, parcels: DataFrame, wanted: DataFrame, key: str = "county", **grid) -> DataFrame:
    """County-wise overlay of layers saved by county, for the counties that ``wanted`` has and both layers share.

    ``wanted`` may be any query: which folders are scanned is decided at run time, by dynamic partition pruning of both
    scans.  Hot cells are counted and split county by county."""
    counties = wanted.select(key).distinct()
    b, p = (df.join(counties, key, "left_semi") for df in (buildings, parcels))
    return overlay(b.withColumnRenamed("oid", "building_oid"), p.withColumnRenamed("oid", "flur_oid"), partition_by=[key], **grid)


def save_tables(buildings: DataFrame, parcels: DataFrame, pairs: DataFrame, name: str, buckets: int | None = None,
                folder: str | None = None) -> None:
    """The persistent mode: ``<name>_buildings``, ``<name>_parcels`` and ``<name>_pairs`` (ids and geometry) as tables in as
    many buckets of their ids; older ones of these names go.  A join of the pairs with the buildings needs no exchange, one
    with the parcels none on the parcels' side.  ``folder``: where the tables lie, else Spark's warehouse."""
    spark = buildings.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df, part, key in ((buildings, "buildings", "building_oid"), (parcels, "parcels", "flur_oid"), (pairs, "pairs", "building_oid")):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
        out = df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet")
        (out.option("path", f"{folder}/{part}") if folder else out).saveAsTable(f"{name}_{part}")


def saved_result(spark: SparkSession, name: str) -> DataFrame:
    """The overlay of the persistent mode: pairs with both attribute sets, joined by id as it is read."""
    pairs, b, p = (spark.table(f"{name}_{part}") for part in ("pairs", "buildings", "parcels"))
    drop = ("geometry", "bbox")
    joined = pairs.join(b.drop(*drop).hint("merge"), "building_oid").join(p.drop(*drop).hint("merge"), "flur_oid")
    return joined.select("geometry", *RESULT_COLUMNS)


def run(spark: SparkSession, roots: list, output: str | None, *, crs: str | None = ETRS89_UTM33N,
        dedup: str = "first", repair_when: str | None = "all", county_wise: bool = False,
        on_missing: str = "error", single_file: bool = False, counts: dict | None = None,
        save_name: str | None = None, buckets: int | None = None, **grid) -> DataFrame | None:
    """Run the job and write GeoParquet to ``output``; returns the written result.

    The result has ``geometry``, ``geom_hash`` and ``RESULT_COLUMNS`` in this
    order; a layer without one of its columns is an error.  ``counts`` (a dict)
    gets the numbers of rows read and kept of each layer and of the result,
    counted during the writes, without a pass of their own.  ``save_name``: the
    persistent mode, tables in buckets (below ``output``, if given) instead of the
    export (``save_tables``).
    """
    try:
        root = resolve_root(roots)
        bpath, ppath = layer_paths(root)
    except FileNotFoundError:
        if on_missing == "skip":
            return None
        raise
    layers = []
    for path, other, columns, name in ((bpath, ppath, BUILDING_COLUMNS, "buildings"), (ppath, bpath, PARCEL_COLUMNS, "parcels")):
        df = read_layer(spark, path, columns, paired_with=other if county_wise else None)
        # decoded once: dedup looks at keys first and at rows then
        df = counted(df, counts, f"{name}_read")
        if dedup == "first" and not county_wise:
            df = written(df, f"{name}-read")
        df = prepare(df, columns + (["county"] if county_wise else []), "none" if county_wise else dedup, repair_when, counts=counts, name=name)
        # written once: the grid join's planning aggregates then read only the bbox column of these tables
        layers.append(written(df, name))
    b, p = layers
    res = overlay_layers(b, p, county_wise=county_wise, **grid)
    if save_name:
        pairs = counted(res.select("building_oid", "flur_oid", "geometry"), counts, "rows")
        save_tables(b.withColumnRenamed("oid", "building_oid"), p.withColumnRenamed("oid", "flur_oid"), pairs, save_name, buckets, output)
        resolve(counts)
        return saved_result(spark, save_name)
    keys = b.select(st_geohash("bbox", 5).alias("geom_hash"), st_grid_hash("bbox", LOCATION_CELL).alias("grid_hash"))
    res = location_ordered(with_location_keys(res), single_file, keys)
    res = counted(res.select("geometry", "geom_hash", *RESULT_COLUMNS), counts, "rows")
    w = res.write.format("gpq").mode("overwrite").option("compression", "zstd").option("version", "1.0.0")
    if crs:
        w = w.option("crs", crs)
    w.save(output)
    resolve(counts)
    return spark.read.parquet(output)
