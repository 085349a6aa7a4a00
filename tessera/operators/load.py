"""Loading of new and changed files into a table, told by a manifest.

``load_new`` lists the files of a pattern (Spark's own listing: no content is
read), sets aside those that the manifest knows with the same length and time,
reads the others and appends them as one numbered load.  The manifest's rows
(path, length, modified, load) are written last, which commits the load: what a
failed load left behind is never read, and the next load replaces it.  ``loaded``
reads of each file its latest load only, so a changed file's older rows are gone
from the table without a rewrite.  Files that vanish keep their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "path string, length long, modified timestamp, load int"


def listing(spark: SparkSession, pattern: str, companions: bool = True) -> DataFrame:
    """(path, length, modified) of the files of a glob pattern; ``companions``: all files that differ in the suffix alone
    (a shapefile's index and attributes) count together with it."""
    stem, dot, suffix = pattern.rpartition(".")
    found = spark.read.format("binaryFile").load(f"{stem}.*" if companions else pattern).select("path", "length", "modificationTime")
    if not companions:
        return found.select(_plain("path").alias("path"), "length", F.col("modificationTime").alias("modified"))
    whole = F.regexp_replace(_plain("path"), r"\.[^./]*$", "")
    parts = found.groupBy(whole.alias("stem")).agg(
        F.sum("length").alias("length"), F.max("modificationTime").alias("modified"),
        F.max(F.when(F.lower("path").endswith(f".{suffix.lower()}"), _plain("path"))).alias("path"))
    return parts.where("path IS NOT NULL").select("path", "length", "modified")


def _plain(path: str):
    """Local paths without a scheme, as the readers name their files."""
    return F.regexp_replace(F.col(path), "^file:/+", "/")


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """The loads so far, one row a file and load."""
    path = f"{target}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if _exists(spark, path) else spark.createDataFrame([], MANIFEST)


def _latest(known: DataFrame) -> DataFrame:
    return known.groupBy("path").agg(F.max_by(F.struct("length", "modified", "load"), "load").alias("f")).select("path", "f.*")


def load_new(spark: SparkSession, pattern: str, target: str, read: Callable[[list], DataFrame], companions: bool = True) -> int:
    """Append the rows of new and changed files to ``target``; returns the number of files loaded.

    ``read(paths)`` gives their rows, with the file's path as ``source_file``.
    """
    known = _latest(manifest(spark, target))
    # a row for each new file reaches the driver, as it does in any listing
    fresh = listing(spark, pattern, companions).join(known, ["path", "length", "modified"], "left_anti").orderBy("path").collect()
    if not fresh:
        return 0
    load = (known.agg(F.max("load")).first()[0] or 0) + 1
    read([r["path"] for r in fresh]).write.mode("overwrite").parquet(f"{target}/data/load={load}")
    done = spark.createDataFrame([(r["path"], r["length"], r["modified"], load) for r in fresh], MANIFEST)
    done.coalesce(1).write.mode("append").parquet(f"{target}/manifest")
    return len(fresh)


def loaded(spark: SparkSession, target: str) -> DataFrame:
    """The table: of each file the rows of its latest load, with the load's number."""
    last = _latest(manifest(spark, target)).select(F.col("path").alias("source_file"), "load")
    return spark.read.parquet(f"{target}/data").join(last, ["source_file", "load"], "left_semi")
