"""Steps shared by the two operators that find repeated passages.

Rows are named by two hashes of id and text, the same on every run and for
every partitioning; fully equal rows share them and get equal results.  ``ref``
has 64 bits; more bits of the name (31 in op10, 16 in op4) ride in the upper
bits of the positions, so that rows whose refs collide keep apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import U64, mix

#: Bits of the bitmap that keeps texts without candidates out of a shuffle (16 MB, whatever the corpus).
FILTER_BITS = 27


def row_ref(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.lit("/"), F.col(text_col))


def row_tag(id_col: str, text_col: str, bits: int) -> Column:
    """Further ``bits`` of a row's name, signed, independent of ``row_ref``."""
    return F.shiftright(F.xxhash64(F.lit("tag"), F.col(id_col), F.lit("/"), F.col(text_col)), 64 - bits)


def tagged(at: np.ndarray, tag: int, shift: int) -> np.ndarray:
    """Positions (below ``1 << shift``) with the tag of their row above them."""
    return at.astype(np.int64) | np.int64(int(tag) << shift)


def maybe_in(df: DataFrame, ref: str, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``ref`` may be in ``refs``, and those for which it surely is not.

    A bitmap of fixed size, only a saving: the first part is joined exactly afterwards.
    """
    place = F.pmod(F.xxhash64(ref), F.lit(1 << FILTER_BITS)) + 1  # Spark's bitmaps count from 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = refs.select(bucket.alias("bits_of"), bit.alias("bit")).groupBy("bits_of").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    # at most 2**FILTER_BITS bits in all
    tested = df.join(F.broadcast(maps), bucket == F.col("bits_of"), "left")
    return tested.where(held).select(*df.columns), tested.where(~held).select(*df.columns)


def adjacent(keys: list) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the rows by ``keys`` (first key first), and for each sorted row its group's number.

    A multikey sort: by the first key alone, then each later key only inside runs of equal earlier keys.  A later key
    may be a function of the rows that are still tied.
    """
    order = np.argsort(keys[0], kind="stable")
    first = keys[0][order]
    new = np.r_[True, first[1:] != first[:-1]] if len(order) else np.zeros(0, bool)
    for key in keys[1:]:
        tied = ~new
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        k = key(order[at]) if callable(key) else key[order[at]]
        inner = np.lexsort((k, group))
        order[at] = order[at][inner]
        k = k[inner]
        new[at[1:]] |= k[1:] != k[:-1]
    return order, np.cumsum(new) - 1


def spread_key(ref: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(ref.view(U64) + at.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


class Chunks:
    """Collects arrays column by column and hands them over once there are enough rows."""

    def __init__(self, limit: int = 400_000):
        self.limit, self.rows, self.parts = limit, 0, []

    def add(self, *columns: np.ndarray) -> bool:
        if len(columns[0]):
            self.parts.append(columns)
            self.rows += len(columns[0])
        return self.rows >= self.limit

    def take(self) -> list[np.ndarray] | None:
        if not self.parts:
            return None
        out = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.rows, self.parts = 0, []
        return out


def grouped(batches, key: int = 0):
    """Arrays of the columns for whole runs of equal keys, of batches that come sorted by ``key``.

    No more than a batch and one unfinished run are held, whatever the partition's size.
    """
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        keys = columns[key]
        cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
        if cut or (held and held[-1][key][-1] != keys[0]):
            if not cut:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            else:
                head = [c[:cut] for c in columns]
                yield [np.concatenate(c) for c in zip(*held, head, strict=True)]
                held = []
        held.append([c[cut:] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def positions(flags: DataFrame, name: str, shift: int) -> DataFrame:
    """One row a named row (``ref``, ``tag``): its distinct positions as a sorted array."""
    return flags.groupBy("ref", F.shiftright(name, shift).alias("tag")).agg(
        F.sort_array(F.collect_set(F.col(name).bitwiseAND(F.lit((1 << shift) - 1)))).alias(name))
