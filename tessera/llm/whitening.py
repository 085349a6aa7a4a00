"""Embedding whitening with MLlib's distributed block matrices.

1. Components become whole numbers, floor(scale * c); the fit list is each
   distinct vector once, with its size n and exact sums per dimension.
2. The fit list's rows are centred, indexed and laid into a BlockMatrix; its
   transpose times itself is the scatter matrix.  The multiplication is split
   over the rows' blocks, so no task sees more than a few of them.
3. The covariance (dimensions squared) is decomposed on the driver by ``eigh``.
4. Every row, centred, is indexed and laid into a BlockMatrix that is multiplied
   by the whitening matrix; the products meet their rows again by their index,
   which is unique, however often a vector repeats.
5. The whitened fit list's covariance, by the same multiplication, is held
   against the identity.

Defined results: rows whose vector is null, empty, of another length than the
most frequent one, or holds null or non-finite entries are dropped; rows with
null id and repeated rows each give their rows; components without variance
(eigenvalue at most 1e-12 of the largest) cannot be whitened and give no rows,
so equal vectors alone, or an empty table, give none; other columns are not
read.  ``deviation`` is exact; one beyond 64 bits ends the job with an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import written

#: Rows of a block; with 1,024 dimensions a block has 8 MB.
BLOCK_ROWS = 1024
#: Blocks whose products are summed in one task.
BLOCKS_A_TASK = 4


def whole_numbers(column: Column, scale: int) -> Column:
    return F.transform(column, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def indexed(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written, with ``index`` from 0 without gaps (a count a written part is all that passes the driver)."""
    part, within = F.shiftright("own", 33), F.col("own").bitwiseAND(F.lit((1 << 33) - 1))
    df = written(df.withColumn("own", F.monotonically_increasing_id()), name)
    sizes = sorted((r["part"], r["n"]) for r in df.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in sizes)])
    spark = df.sparkSession
    place = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, starts, strict=False)], "part long, start long")
    return df.join(F.broadcast(place), part.cast("long") == F.col("part")).withColumn("index", F.col("start") + within).drop("own", "part", "start"), int(starts[-1])


def block_matrix(df: DataFrame, vector: Column, rows: int, dims: int) -> BlockMatrix:
    lines = MLUtils.convertVectorColumnsFromML(df.select("index", array_to_vector(vector).alias("vector")), "vector")
    return IndexedRowMatrix(lines, rows, dims).toBlockMatrix(BLOCK_ROWS, dims)


def times_itself(m: BlockMatrix, rows: int) -> np.ndarray:
    """Transpose times matrix; the rows' blocks are dealt over several tasks (MLlib's argument for the middle dimension)."""
    blocks = -(-rows // BLOCK_ROWS)
    product = m.transpose()._java_matrix_wrapper.call("multiply", m._java_matrix_wrapper._java_model, max(1, -(-blocks // BLOCKS_A_TASK)))
    return BlockMatrix(product, m.numCols(), m.numCols()).toLocalMatrix().toArray()


def times_small(m: BlockMatrix, w: np.ndarray, spark) -> BlockMatrix:
    """A tall block matrix times a matrix of one block."""
    block = Matrices.dense(*w.shape, w.ravel(order="F").tolist())
    return m.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), *w.shape))


def rows_of(m: BlockMatrix) -> DataFrame:
    """(index, y) of each row; the rows stay on the JVM side."""
    lines = callMLlibFunc("getIndexedRows", m.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(lines, "vector").select("index", vector_to_array("vector").alias("y"))


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """A row for each kept row and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    spark = df.sparkSession
    v = F.col("v")
    kind = dict(df.select(F.col(id_col).alias("id")).dtypes)["id"]
    empty = spark.createDataFrame([], f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(v.isNotNull() & (F.size("v") > 0) & sound)
    all_rows, n_rows = indexed(kept.select("id", whole_numbers(v, scale).alias("x")), "whiten-rows")
    lengths = all_rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if lengths is None:
        return empty
    dims = lengths["dims"]
    if lengths["count"] < n_rows:
        all_rows, n_rows = indexed(all_rows.where(F.size("x") == dims).select("id", "x"), "whiten-rows")
    fit, n = indexed(all_rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whiten-fit")
    each = fit.select(F.posexplode("x").alias("k", "c")).groupBy("k").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in sorted(each.collect())]  # a row a dimension
    if max(map(abs, sums)) >= 2**63:
        raise OverflowError("a sum over the vectors is beyond 64 bits")
    mean = F.array(*(F.lit(s / n) for s in sums))
    centred = F.zip_with("x", mean, lambda a, m: a.cast("double") - m)
    table = block_matrix(fit, centred, n, dims)
    scatter = times_itself(table, n)
    cov = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > 1e-12 * max(values.max(), 0)] if values.max() > 0 else order[:0]
    if not len(order):
        return empty
    w = vectors[:, order] / np.sqrt(values[order])
    white = times_small(table, w, spark)
    error = float(np.abs(times_itself(white, n) / n - np.eye(len(order))).max())
    explained = values[order] / np.trace(cov)
    projected = written(rows_of(times_small(block_matrix(all_rows, centred, n_rows, dims), w, spark)), "whiten-projected")
    off = F.zip_with("x", F.array(*(F.lit(s).cast("long") for s in sums)), lambda a, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), a), s))
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))  # null: overflow
    checked = F.coalesce(deviation, F.raise_error(F.lit("deviation is beyond 64 bits")).cast("long"))
    each = all_rows.select("index", "id", checked.alias("deviation")).join(projected, "index")
    return each.select("id", "deviation", F.posexplode("y").alias("k", "whitened")).select(
        F.col("id").alias(id_col), (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*(F.lit(float(e)) for e in explained)), F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))

