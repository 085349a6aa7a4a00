"""Suffix-array dedup: removes every byte covered by a string of ``length`` bytes that also starts anywhere else.

Sorting the suffixes at all bytes would move ``length`` bytes for each of
them.  The array here is sparse: suffixes stand for the strings around them.
The leading token of a suffix is the ``token`` bytes it starts with (64); a
string's anchor is the position whose token has the smallest hash, so equal
strings have the same anchor at the same place, and consecutive strings with
one anchor form a block.

1. Blocks meet by their token's hash.  A token that stands once cannot start a
   repeat: its block is dropped.  Blocks that are equal as a whole repeat as a
   whole.  Each task combines its own blocks first and sends one row a token,
   so a common passage costs a row a task.
2. What is left are tokens with different blocks: the edges of repeats.  Their
   suffixes, with the bytes around them, are written, and splitters sampled
   from their leading tokens (the bytes themselves, in order) range-partition
   them.  A bucket sorts its suffixes by leading token; strings that share it
   are sorted by multikey quicksort, byte word by byte word inside ties only,
   and neighbours that are equal to the last byte repeat.  A run of one token
   that crosses from one batch to the next is carried over that boundary; the
   splitters lie between tokens, so between buckets no equal suffixes part.
3. A token with more than ``hot`` blocks would not fit a bucket; its strings
   are dealt by two fingerprints of all their bytes instead, again combined in
   each task.

Texts without candidates stay out of the shuffles (a bitmap of fixed size).

Defined results: null text counts as empty; texts shorter than ``length``
lose nothing and cause nothing; repeated rows are elsewhere to each other;
overlapping occurrences count; ids are carried, null and repeated ones too; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._repeats import Chunks, adjacent, batch, grouped, maybe_in, positions, row_ref, row_tag, spread_key, tagged
from ._work import U64, Roller, cover_mask, runs_of, ship, sliding_min, written
from .substring_dedup import _texts, finish

#: A block's place: first string, number of strings (8 bits), anchor's distance from the first string (8 bits).
#: Places have 48 bits, the rows' tags above them 16.
SHIFT = 48
_SINGLE, _DOUBLE, _MIXED, _REPEATED, _EDGE = range(5)

_rollers: list[Roller] = []


def rollers() -> list[Roller]:
    """Hashes of bytes, one set a worker: for tokens, strings and strings again."""
    if not _rollers:
        _rollers.extend(Roller(s) for s in (31, 32, 33))
    return _rollers


def blocks(data: np.ndarray, length: int, token: int, piece: int = 1 << 20):
    """Blocks of a text, piece by piece: name of the leading token, hash of the block, place."""
    names, strings, _ = rollers()
    width = length - token + 1
    for low in range(0, len(data) - length + 1, piece):
        part = data[low : low + piece + length - 1]
        h = names.windows(names.prefix(names.table[part]), token)
        order = (h & ~U64((1 << 24) - 1)) | np.arange(len(h), dtype=U64)  # the first of equal names wins
        anchor = (sliding_min(order, width) & U64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[first, len(anchor)])
        end = first + count + length - 1
        whole = strings.spans(strings.prefix(strings.table[part]), first, end) + count.astype(U64)
        yield h[anchor[first]], whole, low + first, count, anchor[first] - first


def pack_place(start: np.ndarray, count: np.ndarray, off: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 16 | count << 8 | off


def _scan(length: int, token: int):
    """(ref, tag, text) -> rows (key, h, s, ref, place, state) of a task's blocks, combined."""

    def combine(columns):
        h, s, ref, place = columns
        order, same = adjacent([h, s])
        h, s, ref, place = h[order], s[order], ref[order], place[order]
        token_of = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1
        rep = np.r_[True, same[1:] != same[:-1]]
        double = np.bincount(same)[same] > 1
        mixed = np.bincount(token_of, rep)[token_of] > 1
        lead = np.r_[True, token_of[1:] != token_of[:-1]]
        sent = [(rep & ~mixed & ~double, _SINGLE), (rep & ~mixed & double, _DOUBLE), (lead & mixed, _MIXED)]
        told = [(double, _REPEATED), (rep & mixed, _EDGE)]
        rows, state = zip(*((np.flatnonzero(m), np.full(int(m.sum()), k, np.int8)) for m, k in sent + told), strict=True)
        rows, state = np.concatenate(rows), np.concatenate(state)
        key = np.where(state <= _MIXED, h[rows].view(np.int64), spread_key(ref[rows], place[rows]))
        return batch(["key", "h", "s", "ref", "place", "state"],
                     [key, h[rows].view(np.int64), s[rows].view(np.int64), ref[rows], place[rows], state])

    def run(batches):
        chunks = Chunks()
        for b in batches:
            for ref, tag, data in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), _texts(b, 2), strict=True):
                if len(data) < length:
                    continue
                for h, s, start, count, off in blocks(data, length, token):
                    if chunks.add(h, s, np.full(len(h), ref), tagged(pack_place(start, count, off), tag, SHIFT)):
                        yield combine(chunks.take())
        if chunks.rows:
            yield combine(chunks.take())

    return run


def _meet(batches):
    """Blocks sorted by key -> (h, ref, place, state): repeated as a whole, or edges."""
    for _, h, s, ref, place, state in grouped(batches):
        told = state >= _REPEATED
        h2, s2, r, p, st = h[~told], s[~told], ref[~told], place[~told], state[~told]
        out = [[h[told]], [ref[told]], [place[told]], [state[told]]]
        if len(h2):
            starts = np.flatnonzero(np.r_[True, h2[1:] != h2[:-1]])  # a key of these is their hash: they are sorted
            size = np.diff(np.r_[starts, len(h2)])
            differ = np.minimum.reduceat(s2, starts) != np.maximum.reduceat(s2, starts)
            differ |= np.maximum.reduceat(st, starts) == _MIXED
            differ, many = np.repeat(differ, size), np.repeat(size > 1, size)
            own = st < _MIXED
            for rows, kind in ((own & differ, _EDGE), (own & ~differ & many, _REPEATED)):
                for o, c in zip(out, (h2, r, p, np.full(len(h2), kind, np.int8)), strict=True):
                    o.append(c[rows])
        yield batch(["h", "ref", "place", "state"], [np.concatenate(o) for o in out])


def _edges(length: int):
    """(ref, tag, text, edge) -> an edge's place and the bytes of its block."""

    def run(batches):
        for b in batches:
            for k, data in enumerate(_texts(b, 2)):
                place = b.column(3)[k].values.to_numpy()
                raw, count = data.tobytes(), place >> 8 & 255
                strings = [raw[s : s + c + length - 1] for s, c in zip((place >> 16).tolist(), count.tolist(), strict=True)]
                yield batch(["ref", "place", "string"], [np.full(len(place), b.column(0)[k].as_py()), tagged(place, b.column(1)[k].as_py(), SHIFT),
                                                         pa.array(strings, pa.binary())])

    return run


def _hot(length: int):
    """(ref, tag, text, hot) -> strings of hot tokens (key, w1, w2, ref, place, state), combined in the task."""

    def combine(columns):
        w1, w2, ref, pos = columns
        order, group = adjacent([w1, w2])
        w1, w2, ref, pos = (c[order] for c in columns)
        rep = np.r_[True, group[1:] != group[:-1]]
        double = np.bincount(group)[group] > 1
        rows = np.concatenate([np.flatnonzero(rep), np.flatnonzero(double)])
        state = np.concatenate([np.where(double[rep], _DOUBLE, _SINGLE), np.full(int(double.sum()), _REPEATED)]).astype(np.int8)
        key = np.where(state == _REPEATED, spread_key(ref[rows], pos[rows]), w1[rows].view(np.int64))
        return batch(["key", "w1", "w2", "ref", "place", "state"], [key, w1[rows].view(np.int64), w2[rows].view(np.int32), ref[rows], pos[rows], state])

    def run(batches):
        chunks = Chunks()
        _, w_a, w_b = rollers()
        for b in batches:
            for k, data in enumerate(_texts(b, 2)):
                place = b.column(3)[k].values.to_numpy()
                count = place >> 8 & 255
                pos = np.repeat(place >> 16, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                a, c = w_a.prefix(w_a.table[data]), w_b.prefix(w_b.table[data])
                w1, w2 = w_a.spans(a, pos, pos + length), (w_b.spans(c, pos, pos + length) >> U64(32)).astype(np.uint32)
                if chunks.add(w1, w2, np.full(len(pos), b.column(0)[k].as_py()), tagged(pos << 16 | 1 << 8, b.column(1)[k].as_py(), SHIFT)):
                    yield combine(chunks.take())
        if chunks.rows:
            yield combine(chunks.take())

    return run


def _met_hot(batches):
    """Strings of hot tokens sorted by key -> (ref, place) of those that stand elsewhere too."""
    for _, w1, w2, ref, place, state in grouped(batches):
        told = state == _REPEATED
        yield batch(["ref", "place"], [ref[told], place[told]])
        own = np.flatnonzero(~told)
        if len(own):
            order, group = adjacent([w1[own], w2[own]])
            alone = own[order[(np.bincount(group)[group] > 1) & (state[own[order]] == _SINGLE)]]
            yield batch(["ref", "place"], [ref[alone], place[alone]])


def sort_strings(token: np.ndarray, ref: np.ndarray, place: np.ndarray, strings, length: int):
    """(ref, place) of runs of strings equal to others, of blocks whose ``token`` numbers tell their leading tokens.

    Multikey quicksort: by token and the anchor's distance, then eight bytes at a time, inside ties alone.
    """
    count = place >> 8 & 255
    size = count + length - 1
    first = np.cumsum(count) - count
    block = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(block)) - first[block]
    data = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    at = (np.cumsum(size) - size)[block] + step
    words = np.lib.stride_tricks.sliding_window_view(data, 8)

    def word(k: int):
        return lambda rows: np.ascontiguousarray(words[at[rows] + k]).view(">u8")[:, 0].astype(U64)

    places = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    # the token itself is equal already where token and distance are
    order, group = adjacent([token[block].astype(np.int64) << 8 | ((place & 255)[block] - step), *(word(k) for k in places)])
    twice = np.zeros(len(step), bool)
    twice[order] = np.bincount(group)[group] > 1
    # runs of neighbouring strings inside a block
    starts = np.flatnonzero(twice & np.r_[True, ~twice[:-1] | (block[1:] != block[:-1])])
    ends = np.flatnonzero(twice & np.r_[~twice[1:] | (block[1:] != block[:-1]), True]) + 1
    begin = (place >> 16)[block[starts]] + step[starts]
    return ref[block[starts]], begin << 16 | (ends - starts) << 8


def _bucket(length: int, at_once: int = 1 << 20):
    """A bucket's suffixes (token, ref, place, string), sorted by token -> (ref, place) of repeated runs.  Whole tokens of
    about ``at_once`` bytes are sorted together."""

    def run(batches):
        for token, ref, place, strings in grouped(batches):
            number = np.cumsum(np.r_[0, token[1:] != token[:-1]])
            total = np.cumsum((place >> 8 & 255) + length - 1)
            a = 0
            while a < len(ref):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + at_once, "right")))
                while b < len(ref) and number[b] == number[b - 1]:
                    b += 1
                if b - a > 1:
                    yield batch(["ref", "place"], list(sort_strings(number[a:b], ref[a:b], place[a:b], strings[a:b], length)))
                a = b

    return run


def _cut(length: int):
    def run(batches):
        for b in batches:
            rows = []
            for k, data in enumerate(_texts(b, 1)):
                place = b.column(2)[k].values
                place = place.to_numpy().astype(np.int64) if place is not None else np.zeros(0, np.int64)
                gone = cover_mask(len(data), place >> 16, (place >> 8 & 255) + length - 1)
                starts, ends = runs_of(gone)
                spans = [{"start": s, "end": e} for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                kept = data[~gone] if len(starts) else data
                rows.append((len(data), int((ends - starts).sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield batch(["doc_key", "n_bytes", "n_removed", "removed", "kept_sha256"],
                        [b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                         pa.array(columns[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                         pa.array(columns[3], pa.string())])

    return run


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, token: int = 64,
          hot: int = 20_000) -> DataFrame:
    """A row per row of ``df``: doc_id, n_bytes, n_removed, removed (array of byte ranges [start, end)), kept_sha256."""
    ship(df)
    if not 0 < token <= length <= token + 254:
        raise ValueError("length must be between token and token + 254")
    if length < 8:
        raise ValueError("length must be 8 or more")
    named = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    docs = named.withColumns({"ref": row_ref("doc_id", "text"), "tag": row_tag("doc_id", "text", 16)})
    scanned = docs.select("ref", "tag", "text").mapInArrow(_scan(length, token), "key bigint, h bigint, s bigint, ref bigint, place bigint, state tinyint")
    met = scanned.repartition("key").sortWithinPartitions("key").mapInArrow(_meet, "h bigint, ref bigint, place bigint, state tinyint")
    flags = written(met, "blocks")
    edges = flags.where(F.col("state") == _EDGE)
    crowded = edges.groupBy(F.col("h").alias("hot_h")).agg(F.count("*").alias("n")).where(F.col("n") > hot)
    edges = edges.join(crowded.select("hot_h"), F.col("h") == F.col("hot_h"), "left")
    own = F.col("place").bitwiseAND(F.lit((1 << SHIFT) - 1))
    by_text = written(edges.groupBy("ref", F.shiftright("place", SHIFT).alias("tag")).agg(
        F.collect_set(F.when(F.col("hot_h").isNull(), own)).alias("edge"),
        F.collect_set(F.when(F.col("hot_h").isNotNull(), own)).alias("hot")), "edges")

    def texts_with(places: str) -> DataFrame:
        some = by_text.where(F.size(places) > 0).select("ref", "tag", places)
        return maybe_in(docs, "ref", some)[0].join(some, ["ref", "tag"]).select("ref", "tag", "text", places)

    suffixes = written(texts_with("edge").mapInArrow(_edges(length), "ref bigint, place bigint, string binary"), "suffixes")
    lead = F.substring("string", F.col("place").bitwiseAND(F.lit(255)).cast("int") + 1, F.lit(token))
    # splitters are sampled by Spark from the tokens; equal tokens stay together
    dealt = suffixes.select(lead.alias("token"), "ref", "place", "string").repartitionByRange("token").sortWithinPartitions("token")
    equal = dealt.mapInArrow(_bucket(length), "ref bigint, place bigint")
    strings = texts_with("hot").mapInArrow(_hot(length), "key bigint, w1 bigint, w2 int, ref bigint, place bigint, state tinyint")
    crowd = strings.repartition("key").sortWithinPartitions("key").mapInArrow(_met_hot, "ref bigint, place bigint")
    whole = flags.where(F.col("state") == _REPEATED).select("ref", "place")
    removed = written(positions(whole.unionByName(equal).unionByName(crowd), "place", SHIFT), "repeats")
    return finish(docs, removed, _cut(length), "n_bytes bigint, n_removed bigint, removed array<struct<start:int,end:int>>, kept_sha256 string")
