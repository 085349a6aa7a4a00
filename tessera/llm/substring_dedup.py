"""Substring dedup with difference-cover anchors.

Removes every word covered by a window of ``window`` words that also starts in
a document with a smaller doc_id.

1. Anchors: word sequences of ``window - period + 1`` words are hashed only at
   positions that lie, modulo ``period``, in a difference cover.  For any two
   positions some shift below the period brings both into the cover, so two
   equal windows share an aligned anchor, wherever they stand.
2. An anchor that stands in two places makes the windows that hold it
   candidates.  Each task combines its own equal anchors first and sends one
   row of each, so a hot anchor costs a row a task.
3. Extension: the candidates' whole windows are compared by a 93-bit
   fingerprint (two polynomial hashes modulo a prime) and the smallest document of each is found, again after
   combining inside each task.  Windows are judged on the input.

Texts that hold no candidate never leave their scan: a bitmap of fixed size
keeps them out of the shuffles.

Defined results: null and empty texts have no words; texts shorter than a
window lose nothing; ids of any type are ordered as Spark orders them; rows
without doc_id come after all others, among
themselves in the order of a hash of their text; rows with the same doc_id
never cause each other's removal; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._repeats import Chunks, adjacent, batch, grouped, maybe_in, positions, row_ref, row_tag, spread_key, tagged
from ._work import U64, Roller, cover_mask, runs_of, ship, word_spans, written

#: Perfect difference sets (every non-zero difference modulo the period, once).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


#: Positions have 32 bits, the rows' tags above them 31.
SHIFT = 32


class Hasher:
    """Hashes of words and of word sequences; one a worker."""

    def __init__(self):
        self.byte = [Roller(11), Roller(12)]
        self.word = [Roller(21), Roller(22)]

    def words(self, data: np.ndarray, which: int, piece: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of all words; long texts are hashed piece by piece."""
        roller = self.byte[which]
        starts, ends = word_spans(data)
        out = np.empty(len(starts), U64)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + piece, "right")))
            low = starts[a]
            prefix = roller.prefix(roller.table[data[low : ends[b - 1]]])
            out[a:b] = roller.spans(prefix, starts[a:b] - low, ends[a:b] - low)
            a = b
        return starts, ends, out

    def windows(self, hashes: np.ndarray, which: int, length: int) -> np.ndarray:
        roller = self.word[which]
        return roller.windows(roller.prefix(hashes), length)


_hasher: list[Hasher] = []


def hasher() -> Hasher:
    if not _hasher:
        _hasher.append(Hasher())
    return _hasher[0]


def anchor_places(n: int, period: int, length: int) -> np.ndarray:
    """Cover positions of a text of n words at which an anchor fits."""
    cover = np.array(COVERS[period])
    p = (np.arange(0, n + period, period)[:, None] + cover).ravel()
    return p[p <= n - length]


def _texts(b: pa.RecordBatch, column: int):
    for t in b.column(column).cast(pa.binary()):
        yield np.frombuffer(t.as_py() or b"", np.uint8)


def _anchors(window: int, period: int):
    """(ref, tag, text) -> anchors (key, h, ref, at, state); state 0: alone in this task so far, 1: repeated here, its rows
    are reported, 2: a reported row."""
    length = window - period + 1

    def combine(columns):
        h, ref, at = columns
        order, group = adjacent([h])
        h, ref, at = h[order], ref[order], at[order]
        first = np.r_[True, group[1:] != group[:-1]]
        many = np.bincount(group)[group] > 1
        rep = first.nonzero()[0]
        known = many.nonzero()[0]
        rows = np.concatenate([rep, known])
        state = np.concatenate([many[rep].astype(np.int8), np.full(len(known), 2, np.int8)])
        key = np.concatenate([h[rep].view(np.int64), spread_key(ref[known], at[known])])
        return batch(["key", "h", "ref", "at", "state"], [key, h[rows].view(np.int64), ref[rows], at[rows], state])

    def run(batches):
        hs, chunks = hasher(), Chunks()
        for b in batches:
            refs, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            for ref, tag, data in zip(refs, tags, _texts(b, 2), strict=True):
                if len(data) < 2 * window - 1:  # too short for so many words
                    continue
                _, _, words = hs.words(data, 0)
                if len(words) < window:
                    continue
                at = anchor_places(len(words), period, length)
                full = chunks.add(hs.windows(words, 0, length)[at], np.full(len(at), ref), tagged(at, tag, SHIFT))
                if full:
                    yield combine(chunks.take())
        if chunks.rows:
            yield combine(chunks.take())

    return run


def _shared(batches):
    """Anchors sorted by key -> (ref, at) of those in two places or more."""
    for _, h, ref, at, state in grouped(batches):
        told = state == 2
        h, alone, r, a = h[~told], state[~told] == 0, ref[~told], at[~told]
        order, group = adjacent([h])
        found = order[(np.bincount(group)[group] > 1) & alone[order]] if len(h) else order
        yield batch(["ref", "at"], [np.concatenate([ref[told], r[found]]), np.concatenate([at[told], a[found]])])


def _windows(window: int, period: int):
    """(ref, tag, id, tie, text, at) -> windows (key, w1, w2, id, tie, ref, pos, state) at candidate positions; state 2: a
    smaller document has it in this task already."""

    def combine(columns):
        w1, w2, ident, tie, ref, pos = columns
        order, group = adjacent([w1, w2])
        w1, w2, ident, tie, ref, pos = (c[order] for c in (w1, w2, ident, tie, ref, pos))
        told = _later(group, ident, tie)
        keep = ~told
        if keep.any():  # the same place may come twice, from equal rows
            k = np.flatnonzero(keep)
            _, once = np.unique(np.stack([group[k], ref[k], pos[k].astype(np.int64)]), axis=1, return_index=True) if _repeated(ref, pos, k) else (None, np.arange(len(k)))
            keep = np.zeros(len(keep), bool)
            keep[k[once]] = True
        rows = np.concatenate([keep.nonzero()[0], told.nonzero()[0]])
        state = np.zeros(len(rows), np.int8)
        state[int(keep.sum()) :] = 2
        key = np.where(state == 2, spread_key(ref[rows], pos[rows]), w1[rows].view(np.int64))
        return batch(["key", "w1", "w2", "id", "tie", "ref", "pos", "state"],
                     [key, w1[rows].view(np.int64), w2[rows].view(np.int32), ident[rows], tie[rows], ref[rows], pos[rows], state])

    def run(batches):
        hs, chunks = hasher(), Chunks()
        for b in batches:
            refs, tags, ids, ties = (b.column(i).to_numpy() for i in range(4))
            for k, data in enumerate(_texts(b, 4)):
                _, _, words = hs.words(data, 0)
                n = len(words) - window + 1
                at = b.column(5)[k].values.to_numpy().astype(np.int64)
                first = np.maximum(at - period + 1, 0)
                pos = np.flatnonzero(cover_mask(n, first[first < n], (at - first + 1)[first < n]))
                if not len(pos):
                    continue
                w1 = hs.windows(words, 0, window)[pos]
                w2 = (hs.windows(hs.words(data, 1)[2], 1, window)[pos] >> U64(32)).astype(np.uint32)
                if chunks.add(w1, w2, *(np.full(len(pos), x[k]) for x in (ids, ties, refs)), tagged(pos, tags[k], SHIFT)):
                    yield combine(chunks.take())
        if chunks.rows:
            yield combine(chunks.take())

    return run


def _repeated(ref: np.ndarray, pos: np.ndarray, k: np.ndarray) -> bool:
    keys = np.sort(spread_key(ref[k], pos[k]))
    return bool((keys[1:] == keys[:-1]).any())


def _later(group: np.ndarray, ident: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Rows (sorted by group) that are not of their group's smallest (ident, tie)."""
    if not len(group):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    low = np.minimum.reduceat(ident, starts)[group]
    late = ident > low
    low_tie = np.minimum.reduceat(np.where(late, np.iinfo(np.int64).max, tie), starts)[group]
    return late | (tie > low_tie)


def _owned(batches):
    """Windows sorted by key -> (ref, pos) of those that a smaller document has too."""
    for _, w1, w2, ident, tie, ref, pos, state in grouped(batches):
        told = state == 2
        w1, w2, i, t, r, p = (c[~told] for c in (w1, w2, ident, tie, ref, pos))
        order, group = adjacent([w1, w2])
        late = order[_later(group, i[order], t[order])]
        yield batch(["ref", "pos"], [np.concatenate([ref[told], r[late]]), np.concatenate([pos[told], p[late]])])


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with numbers (id, tie) that order them by doc_id, whatever its type; rows without it come last, by a hash."""
    doc_id = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        docs = docs.withColumn("id", doc_id.cast("long"))
    else:  # numbers that rise from sorted partition to sorted partition
        order = docs.select(doc_id.alias("same_id")).where("same_id IS NOT NULL").distinct().orderBy("same_id")
        order = written(order.withColumn("id", F.monotonically_increasing_id()), "ids")
        docs = docs.join(order, doc_id == F.col("same_id"), "left")
    none = doc_id.isNull()
    return docs.withColumns({"id": F.when(none, F.lit((1 << 63) - 1)).otherwise(F.col("id")), "tie": F.when(none, F.col("ref")).otherwise(F.lit(0))})


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int = 31) -> DataFrame:
    """A row per row of ``df``: doc_id, n_words, n_removed, kept (array of kept [start, end) word ranges), kept_sha256."""
    ship(df)
    if not period < window or period not in COVERS:
        raise ValueError(f"period must be one of {sorted(COVERS)} and below the window")
    named = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = named.withColumns({"ref": row_ref("doc_id", "text"), "tag": row_tag("doc_id", "text", 31)})
    anchors = docs.select("ref", "tag", "text").mapInArrow(_anchors(window, period), "key bigint, h bigint, ref bigint, at bigint, state tinyint")
    shared = anchors.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "ref bigint, at bigint")
    marked = written(positions(shared, "at", SHIFT), "anchors")
    texts = numbered(maybe_in(docs, "ref", marked)[0].join(marked, ["ref", "tag"])).select("ref", "tag", "id", "tie", "text", "at")
    found = texts.mapInArrow(_windows(window, period), "key bigint, w1 bigint, w2 int, id bigint, tie bigint, ref bigint, pos bigint, state tinyint")
    owned = found.repartition("key").sortWithinPartitions("key").mapInArrow(_owned, "ref bigint, pos bigint")
    removed = written(positions(owned, "pos", SHIFT), "windows")
    return finish(docs, removed, _cut_words(window), "n_words bigint, n_removed bigint, kept array<struct<start:int,end:int>>, kept_sha256 string")


def finish(docs: DataFrame, removed: DataFrame, cut, schema: str) -> DataFrame:
    """Apply ``cut`` to every text with its positions; texts without any stay out of the shuffle."""
    docs = docs.withColumn("doc_key", F.struct("doc_id"))
    kind = f"doc_key struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()}>, {schema}"
    hit, rest = maybe_in(docs, "ref", removed)
    none = F.array().cast(removed.schema[2].dataType)
    touched = hit.join(removed, ["ref", "tag"], "left").select("doc_key", "text", F.coalesce(removed.columns[2], none).alias("pos"))
    rest = rest.select("doc_key", "text", none.alias("pos"))
    out = touched.mapInArrow(cut, kind).unionByName(rest.mapInArrow(cut, kind))
    return out.select("doc_key.doc_id", *out.columns[1:])


def _cut_words(window: int):
    def run(batches):
        for b in batches:
            rows = []
            for k, data in enumerate(_texts(b, 1)):
                pos = b.column(2)[k].values
                words = data.tobytes().split()
                gone = cover_mask(len(words), pos.to_numpy().astype(np.int64), window) if pos is not None and len(pos) else np.zeros(len(words), bool)
                kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                ranges = [{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in runs_of(~gone)), strict=True)]
                rows.append((len(words), int(gone.sum()), ranges, hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield batch(["doc_key", "n_words", "n_removed", "kept", "kept_sha256"],
                        [b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                         pa.array(columns[3], pa.string())])

    return run
