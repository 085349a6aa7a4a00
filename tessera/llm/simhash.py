"""SimHash near-duplicate groups by bit-sliced comparison.

A document's fingerprint has bit b set if more than half of its word
shingles' XXH64 values have it.  Fingerprints link at ``radius`` or fewer
differing bits; groups are the connected components.

Scale: copies are collapsed to distinct fingerprints first.  The 64 bits are
cut into ``bands``; two linked fingerprints agree on at least
``bands - radius`` whole bands, so each fingerprint is sent to one bucket per
choice of that many bands and compared inside its buckets only.  A bucket
above ``block`` fingerprints is cut into blocks that meet pairwise, each pair
a separate unit of work, so no bucket is capped or held in one task.  Within
a bucket the comparison is bit-sliced: 64 fingerprints form a word per bit
plane, carry-save counters add the differing planes for all of them at once,
and a word is abandoned as soon as all its fingerprints exceed the radius.
Each task emits a spanning forest of its links, never all pairs.

Defined results: null or empty texts and texts without words have fingerprint
0 and link like any other; repeated rows stay and share a group; null doc_ids
take part, but name a group only if it has no other id (the name is then
null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._components import components, forest
from ._repeats import grouped
from ._work import U64, ship, written

ONES = U64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int) -> int:
    """Signed 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits on ASCII white space
    n = len(words)
    if not n:
        return 0
    if n < shingle:
        return int(U64(xxhash.xxh64_intdigest(b" ".join(words), 42)).astype(np.int64))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = (starts + sizes)[shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    total = n - shingle + 1
    for at in range(0, total, 1 << 15):
        spans = zip(starts[at : min(at + (1 << 15), total)].tolist(), ends[at : at + (1 << 15)].tolist(), strict=True)
        h = np.array([digest(joined[s:e], 42) for s, e in spans], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            counts += np.add.reduce(bits[part : part + 255], axis=0, dtype=np.uint8)
    packed = np.packbits(counts * 2 > total, bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(text, shingle: int):
    """Column: fingerprint of a text column."""
    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py() or b"", shingle) for t in texts.cast(pa.binary())], pa.int64())

    return simhash(text)


def _add(counters: list[np.ndarray], over: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Add two bit planes: a carry-save adder on the lowest counter, then the carries ripple up."""
    low = counters[0]
    x = low ^ a
    carry = (low & a) | (x & b)
    np.bitwise_xor(x, b, out=low)
    for c in counters[1:]:
        up = c & carry
        c ^= carry
        carry = up
    over |= carry


def _above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count exceeds the radius."""
    above, same = np.zeros_like(over), np.full_like(over, ONES)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same &= counters[i]
        else:
            above |= same & counters[i]
            same &= ~counters[i]
    return over | above


def bit_sliced(fps: np.ndarray, bucket: np.ndarray, radius: int, chunk: int = 1 << 15):
    """Links inside each bucket (``bucket`` is sorted): yields arrays (i, j) of row numbers, i < j."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    lanes = int(words.sum()) * 64
    rank = np.arange(n) - np.repeat(starts, sizes)
    lane = np.repeat(first_word, sizes) * 64 + rank
    row_of = np.full(lanes, -1, np.int64)
    row_of[lane] = np.arange(n)
    planes = np.empty((64, lanes // 64), U64)
    own = fps.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        for bit in range(8):
            flags = np.zeros(lanes, np.uint8)
            flags[lane] = own[:, byte] >> bit & 1
            planes[byte * 8 + bit] = np.packbits(flags, bitorder="little").view("<u8")
    used = np.packbits((row_of >= 0).astype(np.uint8), bitorder="little").view("<u8")
    per_row = np.repeat(words, sizes)
    last = np.cumsum(per_row)
    width = max(1, radius.bit_length())
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(last, (last[at - 1] if at else 0) + chunk, "right")))
        count = per_row[at:to]
        q = np.repeat(np.arange(at, to), count)
        w = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.repeat(first_word, sizes)[at:to], count)
        counters = [np.zeros(len(q), U64) for _ in range(width)]
        over = ~used[w]
        for p in range(0, 64, 2):
            a, b = (planes[k][w] ^ (U64(0) - (fps[q] >> U64(k) & U64(1))) for k in (p, p + 1))
            _add(counters, over, a, b)
            if p % 8 == 6:
                alive = _above(counters, over, radius) != ONES
                if not alive.all():
                    q, w, over = q[alive], w[alive], over[alive]
                    counters = [c[alive] for c in counters]
        near = ~_above(counters, over, radius)
        hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        i, j = q[hit >> 6], row_of[w[hit >> 6] * 64 + (hit & 63)]
        keep = i < j
        yield i[keep], j[keep]
        at = to


def _links(radius: int):
    def links(batches):
        for bucket, fps in grouped(batches):  # whole buckets, sorted
            same = np.r_[False, bucket[1:] == bucket[:-1]]
            many = same | np.r_[same[1:], False]
            bucket, fps = bucket[many], fps[many].view(U64)
            if not len(fps):
                continue
            parent = np.arange(len(fps))
            for i, j in bit_sliced(fps, bucket, radius):
                parent = forest(parent, i, j)
            child = np.flatnonzero(parent != np.arange(len(fps)))
            signed = fps.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[parent[child]])], names=["u", "v"])

    return links


def groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4,
           bands: int = 6, block: int = 4096) -> DataFrame:
    """A row per row of ``df``: doc_id, fp (signed long), component_id (smallest doc_id of the group)."""
    ship(df)
    rows = written(df.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), shingle).alias("fp")), "simhash")
    return rows.join(labels(rows, radius=radius, bands=bands, block=block), "fp").select("doc_id", "fp", "component_id")


def labels(rows: DataFrame, *, radius: int = 4, bands: int = 6, block: int = 4096) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``rows`` (doc_id, fp); root is its group's key."""
    if bands <= radius:
        raise ValueError("bands must exceed radius")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    cuts = [64 * i // bands for i in range(bands + 1)]
    masks = [sum(((1 << cuts[b + 1]) - (1 << cuts[b])) for b in chosen) for chosen in combinations(range(bands), bands - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("t", "k")
    keyed = distinct.select("fp", keys)
    large = (keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > block)
             .withColumn("cuts", F.ceil(F.col("n") / F.lit(block / 2)).cast("int")))
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("cuts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1),
                        lambda o: F.least(o, F.col("own")) * F.col("cuts") + F.greatest(o, F.col("own")))
    dealt = (keyed.join(large, ["t", "k"], "left").withColumn("own", own)
             .withColumn("unit", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(-1))).otherwise(meets)))
             .select(F.xxhash64("t", "k", "unit").alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket", "fp"))
    edges = dealt.mapInArrow(_links(radius), "u bigint, v bigint")
    roots = components(edges)
    named = distinct.join(roots, distinct.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named.select("fp", "doc_id", "root"), "simhash-roots")
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return written(named.join(names, "root").select("fp", "root", "component_id"), "simhash-labels")


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``df`` with one row of each group: the smallest doc_id (null last, then by fingerprint); all columns kept.

    The row to keep is chosen per fingerprint first, so a common text costs a row a task; texts are
    compared with the chosen rows' numbers only.
    """
    ship(df)
    shingle = params.pop("shingle", 4)
    fp, row = "fp_of_simhash_stage", "row_of_simhash_stage"
    marked = df.withColumn(fp, fingerprints(F.col(text_col), shingle)).withColumn(row, F.monotonically_increasing_id())
    marked = written(marked, "simhash-docs")  # fixes the row numbers
    rows = marked.select(F.col(id_col).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("a"))
    named = first.join(labels(rows, **params), "fp")
    best = named.groupBy("root").agg(F.min(F.struct("a.none", "a.doc_id", "fp", "a.row")).alias("b"))
    kept = marked.join(best.select(F.col("b.row").alias("kept_row_of_simhash_stage")),
                       F.col(row) == F.col("kept_row_of_simhash_stage"), "left_semi")
    return kept.select(*df.columns)
