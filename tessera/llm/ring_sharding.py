"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

A ring of ``2**cell_bits`` cells carries ``vnodes`` virtual nodes of each
shard.  A row's place comes from its key; it belongs to the next virtual node
clockwise.  Every shard takes its share of the rows and no more (counts at
most one apart, law ``rows``); keys that meet a full shard continue clockwise
to the next shard with room.

Scale: rows are counted per cell; that table has a fixed size, so the walk
round the ring runs on counts alone.  It gives each cell a few runs of ranks
and their shards, a table bounded by cells plus shards, which is joined back
by cell.  Within a cell rows are ranked by key hash, so a row moves only if
its own stretch of the ring changes hands.  No row passes the driver.

Defined results: null text has no bytes (size 8, checksum 0); null and
repeated ids are keys like any other, their rows being spread by their text
as well; fully equal rows are interchangeable; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._work import written


def ring(shards: int, vnodes: int, cell_bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise.  A shard's nodes do not depend on the other shards."""
    nodes = []
    for s in range(shards):
        for v in range(vnodes):
            h = hashlib.blake2b(f"{s}:{v}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(h, "big") >> (64 - cell_bits), s))
    return sorted(nodes)


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Place the rows of each cell, in ring order: (cell, first rank, end rank, shard, first slot)."""
    n = len(nodes)
    after = list(range(n + 1))  # next node that may have room, with path halving; n stands for the first node

    def find(i: int) -> int:
        while after[i] != i:
            after[i] = after[after[i]]
            i = after[i]
        return i

    cells = [c for c, _ in nodes]
    used = [0] * len(room)
    runs = []
    for cell in sorted(counts):
        rank, left = 0, counts[cell]
        at = bisect.bisect_left(cells, cell)
        while left:
            at = find(at)
            if at == n:
                at = find(0)
            shard = nodes[at][1]
            take = min(left, room[shard] - used[shard])
            if take:
                if runs and runs[-1][0] == cell and runs[-1][3] == shard:
                    runs[-1] = (cell, runs[-1][1], rank + take, shard, runs[-1][4])
                else:
                    runs.append((cell, rank, rank + take, shard, used[shard]))
                used[shard] += take
                rank += take
                left -= take
            if used[shard] == room[shard]:
                after[at] = at + 1
    return runs


def assign(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, vnodes: int = 128,
           cell_bits: int = 14) -> DataFrame:
    """A row per row of ``df``: doc_id, size, text_crc32, shard, slot."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = written(df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col), F.xxhash64(text)).alias("h")), "ring")
    slim = slim.withColumn("cell", F.shiftrightunsigned("h", 64 - cell_bits))
    counts = {r[0]: r[1] for r in slim.groupBy("cell").count().collect()}  # at most 2**cell_bits rows
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    runs = walk(counts, ring(shards, vnodes, cell_bits), room)
    table = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "cell long, first long, until long, shard int, base long")
    ranked = slim.withColumn("rank", F.row_number().over(
        W.partitionBy("cell").orderBy("h", "doc_id", "text_crc32")).cast("long") - 1)
    # bounded by cells and shards, whatever the corpus
    placed = ranked.join(F.broadcast(table.groupBy("cell").agg(F.collect_list(F.struct("until", "first", "shard", "base")).alias("runs"))), "cell")
    own = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["until"]))[0]
    return placed.withColumn("run", own).select(
        "doc_id", "size", "text_crc32", F.col("run.shard").alias("shard"),
        (F.col("run.base") + F.col("rank") - F.col("run.first")).alias("slot"))
