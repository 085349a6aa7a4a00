"""Shared scratch tables and byte-array helpers of the operators here."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .. import _ship

U64 = np.uint64


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` (shared by all executors).

    Only a local session may run without that setting; it gets a temporary
    folder.  A cluster session without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessera-llm-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a scratch table and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(df: DataFrame) -> SparkSession:
    """Make this package importable on the executors and return the session."""
    _ship.ensure(df.sparkSession)
    return df.sparkSession


def values(column):
    """Python values of an Arrow array one by one: a batch's texts are never all held at once."""
    return (x.as_py() for x in column)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


#: Modulus of the polynomial hashes: the Mersenne prime 2**61 - 1.
PRIME = (1 << 61) - 1


def modulo(x: np.ndarray) -> np.ndarray:
    """``x`` below 2**64 modulo the prime."""
    x = (x & U64(PRIME)) + (x >> U64(61))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def times_modulo(a: np.ndarray, b: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 31 and 30 bits; piece by piece, for the caches."""
    out = np.empty(np.broadcast(a, b).shape, U64)
    low31, low30 = U64((1 << 31) - 1), U64((1 << 30) - 1)
    for i in range(0, len(out), at_once):
        x, y = a[i : i + at_once], b[i : i + at_once] if b.ndim else b
        x1, x0, y1, y0 = x >> U64(31), x & low31, y >> U64(31), y & low31
        middle = x1 * y0 + x0 * y1
        # 2**62 counts as 2, 2**61 as 1
        out[i : i + at_once] = modulo(x1 * y1 * U64(2) + (middle >> U64(30)) + ((middle & low30) << U64(31)) + x0 * y0)
    return out


class Roller:
    """Polynomial hashes, modulo a prime, of all fixed-length windows of an array.

    ``windows(prefix(values), k)`` is the hash of ``values[i:i+k]`` for every i.
    The base has an inverse, so one prefix sum serves any length.  Different
    ``seed`` give independent hashes.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 32, PRIME, dtype=np.uint64))
        self.inverse = pow(self.base, -1, PRIME)
        self.table = rng.integers(1, PRIME, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([p, times_modulo(p, np.asarray(pow(base, k, PRIME), U64))])
                                  for p, base in ((self.up, self.base), (self.down, self.inverse)))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of ``values`` (uint64, taken modulo the prime), one longer than it."""
        self._powers(len(values) + 1)
        terms = times_modulo(modulo(values), self.up[: len(values)])
        out = np.zeros(len(values) + 1, U64)
        # sums of halves stay below 2**61 for 2**30 values
        high, low = np.cumsum(terms >> U64(31)), np.cumsum(terms & U64((1 << 31) - 1))
        out[1:] = modulo((high >> U64(30)) + ((high & U64((1 << 30) - 1)) << U64(31)) + low)
        return out

    def _hash(self, ends: np.ndarray, starts: np.ndarray, down: np.ndarray) -> np.ndarray:
        return mix(times_modulo(modulo(ends + (U64(PRIME) - starts)), down))

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the spans [start, end)."""
        return self._hash(prefix[end], prefix[start], self.down[start])

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = len(prefix) - k
        if n <= 0:
            return np.zeros(0, U64)
        return self._hash(prefix[k:], prefix[:n], self.down[:n])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the entropy of every bit (public 64-bit mixing constants)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word (runs without ASCII white space) of a uint8 array."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by block prefix and suffix minima."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of True."""
    wide = np.zeros(len(mask) + 2, bool)
    wide[1:-1] = mask
    edge = np.flatnonzero(wide[1:] != wide[:-1])
    return edge[0::2], edge[1::2]


def cover_mask(n: int, starts: np.ndarray, length) -> np.ndarray:
    """Positions below n covered by [start, start + length) for any of the starts."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, n), -1)
    return np.cumsum(change[:n]) > 0
