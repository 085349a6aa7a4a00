"""Exact top-k search by inner product in an M-tree.

Vectors are integers, so scores are exact.  For the search each vector gets
one more component, the square root of the largest squared norm less its own;
then a higher inner product is a smaller Euclidean distance, which is a
metric.

The tree is paged.  Its top level are ``pivots`` routing vectors; each holds
the vectors nearest to it, dealt over pages trees of at most ``page_rows``
rows (a common vector's copies are dealt over several by row).  Inside such a
tree vectors are split by distance to sampled centres down to leaves of
``leaf`` rows; every node keeps its pivot, covering radius and distance to the
parent's pivot, every leaf entry its distance to the leaf's pivot.  A page is
a table row; the pages' pivots and radii form the top level.

A query first searches the tree page of its own pivot, which gives a bound;
then all pages whose covering radius the bound reaches.  A search is
best-first: a heap of nodes by lower bound; children and leaf entries are
ruled out by ``|d(query, parent) - d(parent, child)|`` before their distance
is computed.  Queries travel in blocks, a block and a page being one unit of
work; per page each query returns at most k rows.

Defined results: vectors that are null or empty of finite numbers only in
part (null, NaN or infinite components), and rows without an id, take no
part; shorter vectors are filled up with zeros; with ``every_row`` all rows of
an id that repeats are candidates and, for its one list of k, queries, and no
row of the query's own id is a candidate; without it such an id counts once,
with its smallest vector; vectors whose scaled squared norm is 2**62 or more
are an error, as their scores may not fit a long; ties go to the smaller id;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._work import ship, written

LIMIT = 1 << 62


class Node:
    """A node of a page's tree; a leaf has ``rows``, an inner node children with their parent distances."""

    __slots__ = ("pivot", "radius", "children", "apart", "radii", "pivots", "rows", "near")

    def __init__(self, pivot):
        self.pivot, self.radius, self.children, self.rows = pivot, 0.0, [], None


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = points - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def grow(points: np.ndarray, rows: np.ndarray, leaf: int, fan: int = 8, pivot: np.ndarray | None = None) -> Node:
    """Bulk-load a tree over ``points[rows]``."""
    node = Node(points[rows[0]] if pivot is None else pivot)
    near = _distances(points[rows], node.pivot)
    node.radius = float(near.max())
    if len(rows) <= leaf or node.radius == 0:
        order = np.argsort(near, kind="stable")
        node.rows, node.near = rows[order], near[order]
        return node
    # centres far from each other, chosen among all rows
    centres, gap = [int(rows[np.argmax(near)])], None
    while len(centres) < fan:
        d = _distances(points[rows], points[centres[-1]])
        gap = d if gap is None else np.minimum(gap, d)
        if gap.max() == 0:
            break
        centres.append(int(rows[np.argmax(gap)]))
    to = np.stack([_distances(points[rows], points[c]) for c in centres])
    owner = to.argmin(axis=0)
    node.children = [grow(points, rows[owner == k], leaf, fan, points[c]) for k, c in enumerate(centres) if (owner == k).any()]
    node.pivots = np.stack([c.pivot for c in node.children])
    node.apart = _distances(node.pivots, node.pivot)
    node.radii = np.array([c.radius for c in node.children])
    return node


def search(root: Node, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int, reach: float,
           largest: float) -> list[tuple[int, int]]:
    """The k best (score, id) of a page for a query, leaving out what is surely farther than ``reach``."""
    best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
    point = np.append(query.astype(float), 0.0)
    norm = float(point @ point)
    margin = 1e-6 * (1.0 + largest**0.5)  # of rounding
    start = float(_distances(root.pivot[None], point)[0])
    heap, count = [(start - root.radius, 0, start, root)], 1
    while heap:
        low, _, at, node = heapq.heappop(heap)
        if low > reach + margin:
            break
        if node.rows is None:
            maybe = np.flatnonzero(np.abs(at - node.apart) - node.radii <= reach + margin)
            for i, x in zip(maybe.tolist(), _distances(node.pivots[maybe], point).tolist(), strict=True):
                low = x - node.radii[i]
                if low <= reach + margin:
                    heapq.heappush(heap, (low, count, x, node.children[i]))
                    count += 1
            continue
        a, b = np.searchsorted(node.near, [at - reach - margin, at + reach + margin])
        rows = node.rows[a:b]
        rows = rows[ids[rows] != query_id]
        scores = vectors[rows] @ query
        if len(rows) > k:  # ties at the k-th place stay
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[keep], scores[keep]
        for entry in zip(scores.tolist(), (-ids[rows]).tolist(), strict=True):
            if len(best) < k:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)
        if len(best) == k:  # distance**2 = |query|**2 + largest - 2 score
            reach = min(reach, max(0.0, norm + largest - 2 * best[0][0]) ** 0.5)
    return [(s, -i) for s, i in best]


def _raise(vectors: np.ndarray, largest: float) -> np.ndarray:
    v = vectors.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(0.0, largest - (v * v).sum(axis=1)))])


def _matrix(column, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, every_row: bool) -> DataFrame:
    """(id, v, key): floor(scale * x) of every component; rows that take part only, and a number of the row."""
    x = F.transform(vector_col, lambda x: x.cast("double"))
    whole = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(whole, F.lit(False)))
    scaled = F.transform(x, lambda x: x * scale)
    norm = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x)
    fits = F.when(norm >= float(LIMIT), F.raise_error(F.lit("op2: a scaled vector is too long for exact scores"))).otherwise(
        F.transform(scaled, lambda x: F.floor(x).cast("long")))
    held = rows.select(F.col(id_col).cast("long").alias("id"), fits.alias("v"))
    if not every_row:
        held = held.groupBy("id").agg(F.min("v").alias("v"))
    return held.withColumn("key", F.monotonically_increasing_id())


def _map(values: dict):
    return F.create_map(*(F.lit(x).cast("int") for pair in sorted(values.items()) for x in pair))


def top_k(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query_modulus: int = 100, k: int = 10,
          scale: int = 1024, pivots: int = 16, page_rows: int = 4096, leaf: int = 256, block: int = 512,
          every_row: bool = False) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for every row whose id is divisible by ``query_modulus``."""
    spark = ship(df)
    base = written(integer_vectors(df, id_col, vector_col, scale, every_row), "vectors")
    squared = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    n, size, largest, asked = base.agg(F.count("*"), F.max(F.size("v")), F.max(squared),
                                       F.count_if(F.col("id") % query_modulus == 0)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size, largest = max(size, 1), float(largest)
    base = base.select("id", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v"))).alias("v"), "key")
    # routing vectors: far from each other in a sample of fixed size, the lowest hashes
    sample = base.orderBy(F.xxhash64("key")).limit(64 * pivots).toArrow()
    points = _raise(np.unique(_matrix(sample.column("v"), size), axis=0), largest)
    chosen, gap = [0], _distances(points, points[0])
    while len(chosen) < pivots and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(points, points[chosen[-1]]))
    centres = points[chosen]

    def route(batches):
        for b in batches:
            p = _raise(_matrix(b.column(1), size), largest)
            nearest = np.stack([_distances(p, c) for c in centres]).argmin(axis=0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest, pa.int32())], names=["id", "v", "key", "pivot"])

    routed = written(base.mapInArrow(route, "id bigint, v array<bigint>, key bigint, pivot int"), "routed")
    sizes = {r[0]: r[1] for r in routed.groupBy("pivot").count().collect()}  # a row a pivot
    cuts = {p: -(-c // page_rows) for p, c in sizes.items()}
    first = {p: sum(cuts[o] for o in cuts if o < p) for p in cuts}
    page = _map(first)[F.col("pivot")] + F.pmod(F.xxhash64("key"), _map(cuts)[F.col("pivot")]).cast("int")

    def build(key, rows):
        vectors, ids, pivot = _matrix(rows.column("v"), size), rows.column("id").to_numpy(), rows.column("pivot")[0].as_py()
        tree = grow(_raise(vectors, largest), np.arange(len(ids)), leaf, pivot=centres[pivot])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([pivot], pa.int32()), pa.array([tree.radius]),
                         pa.array([pickle.dumps((tree, vectors.astype(np.int32 if np.abs(vectors).max(initial=0) < 1 << 31 else np.int64), ids))], pa.binary())],
                        names=["page", "pivot", "radius", "tree"])

    pages = written(routed.withColumn("page", page).groupBy("page").applyInArrow(build, "page int, pivot int, radius double, tree binary"), "pages")
    top = pages.select("page", "pivot", "radius").toArrow()  # a row for page_rows vectors
    queries = routed.where(F.col("id") % query_modulus == 0).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-asked // block)))).cast("int"))

    def look(key, tree, asked):
        out = []
        if tree.num_rows:
            root, vectors, ids = pickle.loads(tree.column("tree")[0].as_py())
            vectors = vectors.astype(np.int64)
            matrix, reach = _matrix(asked.column("v"), size), asked.column("reach").to_pylist()
            for i, q in enumerate(asked.column("id").to_pylist()):
                out += [(q, x, s) for s, x in search(root, vectors, ids, matrix[i], q, k, reach[i], largest)]
        t = np.array(out, np.int64).reshape(-1, 3)
        return pa.table([pa.array(t[:, j]) for j in range(3)], names=["query_id", "vec_id", "score"])

    def run(units: DataFrame) -> DataFrame:
        """Search each page for each block of queries (page, block, id, v, reach) that goes there."""
        keys = units.select(F.col("page").alias("p"), F.col("block").alias("b")).distinct()
        visits = pages.select(F.col("page").alias("own"), "tree").join(keys, F.col("own") == F.col("p")).select("p", "b", "tree")
        return (visits.groupBy("p", "b").cogroup(units.groupBy("page", "block"))
                .applyInArrow(look, "query_id bigint, vec_id bigint, score bigint"))

    home = queries.select(_map(first)[F.col("pivot")].alias("page"), "block", "id", "v", F.lit(float("inf")).alias("reach"))
    near = written(run(home), "home-hits")
    kth = near.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("low"))
    reach = F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), squared + F.lit(largest) - 2 * F.col("low"))))
    bounded = queries.join(kth, "id", "left").withColumn("reach", F.coalesce(reach, F.lit(float("inf"))))
    numbers, of, radii = top.column("page").to_numpy(), top.column("pivot").to_numpy(), top.column("radius").to_numpy()
    margin = 1e-6 * (1.0 + largest**0.5)

    def spread(batches):
        """A row for every page that a query's reach meets, but its home page."""
        for b in batches:
            v = _matrix(b.column(1), size)
            points = np.column_stack([v.astype(float), np.zeros(len(v))])
            away = np.stack([_distances(points, c) for c in centres], axis=1)[:, of]
            done = np.array([first[p] for p in b.column(2).to_pylist()], np.int64).reshape(-1, 1)
            go = (away - radii <= b.column(4).to_numpy()[:, None] + margin) & (numbers != done)
            i, j = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([pa.array(numbers[j], pa.int32()), *(b.column(c).take(pa.array(i)) for c in (3, 0, 1, 4))],
                                             names=["page", "block", "id", "v", "reach"])

    units = bounded.select("id", "v", "pivot", "block", "reach").mapInArrow(
        spread, "page int, block int, id bigint, v array<bigint>, reach double")
    hits = near.unionByName(run(written(units, "visits")))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
