"""Best-fit packing of token sequences by hierarchical residual packing.

1. Every document becomes token ids followed by a separator; longer ones are
   cut into pieces of ``capacity`` tokens, the last piece keeps the rest.
2. Each input partition packs its pieces best-fit (longest first, into the
   bin with the least room that still holds it).  Bins with at most
   ``slack`` tokens of room are final.
3. Under-full bins become items themselves.  They are dealt over ever fewer
   tasks and packed best-fit again, round after round.  A task takes about
   ``items_per_task`` bins, so no task grows with the input.  Rounds end when
   one task has seen all that is left, or the bins no longer get fewer.

A bin carries its members (at most ``capacity``, as each has one token or
more), so no row is matched by an id: null and repeated doc_ids are packed
like any other.  Every round is a written table: a lost executor costs one
round's tasks and never changes bins that were handed on.

Defined results: null text counts as empty, and an empty document is one
piece holding the separator; an empty table gives no rows; only the two named
columns are read, so extra columns may have any name.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import ship, written

_MEMBER = "struct<doc_id:{id},piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"


class WordIds:
    """Ids of a text, word by word, the same as the tokenizer's ids of the whole text.

    The tokenizer never joins characters across white space, so ids of words
    can be kept and reused.  Words of plain letters, digits and ASCII marks
    are cut with the tokenizer's own pattern and looked up in its model; all
    others go through the tokenizer itself.  Both caches are bounded.
    """

    CACHED_WORDS, CACHED_PARTS = 200_000, 300_000
    #: Fixed by the vocabulary file: its split pattern, for words of these characters.
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(keep)]
        self.byte_chars = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex")
        self.simple = split == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= self.CACHED_PARTS:
                self.parts.clear()
            shown = part if part.isascii() else "".join(self.byte_chars[b] for b in part.encode())
            ids = self.parts[part] = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(shown)])
        return ids

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.simple and self.PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self._part, self.PARTS.findall(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        """Little-endian 32-bit ids of a UTF-8 text."""
        known = self.words
        if len(known) >= self.CACHED_WORDS:
            known.clear()
        words = text.split()
        new = [w for w in words if w not in known]
        for w in new:
            known[w] = self._word(w)
        ids = b"".join(map(known.__getitem__, words))
        if len(known) > 2 * self.CACHED_WORDS:  # one very long text
            known.clear()
        return ids


_loaded: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """One per Python worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item indexes of each bin.  A bit mask of the rooms in use finds the tightest bin."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    bins: list[list[int]] = []
    for i in order:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        room -= size
        if room:
            if not open_bins[room]:
                rooms |= 1 << room
            open_bins[room].append(k)
    return bins


def _pack(fills: np.ndarray, first: np.ndarray, members: pa.StructArray, capacity: int, slack: int) -> pa.RecordBatch:
    """Pack items (fill, members from ``first[i]`` to ``first[i+1]``) into bins; one output row a bin."""
    bins = best_fit(fills, capacity)
    flat = np.fromiter((i for b in bins for i in b), np.int64)
    per_bin = np.fromiter(map(len, bins), np.int64, len(bins))
    last_of_bin = np.cumsum(per_bin)
    ahead = np.cumsum(fills[flat]) - fills[flat]
    base = np.repeat(ahead[last_of_bin - per_bin], per_bin) if len(bins) else ahead
    moved = ahead - base
    counts = (first[1:] - first[:-1])[flat]
    total = int(counts.sum())
    take = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[:-1][flat], counts)
    picked = members.take(pa.array(take))
    offset = picked.field("offset").to_numpy(zero_copy_only=False) + np.repeat(moved, counts)
    fields = [picked.field(i) for i in range(picked.type.num_fields - 1)] + [pa.array(offset, pa.int64())]
    picked = pa.StructArray.from_arrays(fields, fields=list(picked.type))
    bin_fill = np.add.reduceat(fills[flat], last_of_bin - per_bin) if len(bins) else fills[:0]
    ends = np.cumsum(counts)[last_of_bin - 1] if len(bins) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), picked)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(bins)), pa.int64()), pa.array(bin_fill, pa.int64()),
         pa.array(bin_fill >= capacity - slack, pa.bool_()), lists],
        names=["bin", "fill", "full", "members"])


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, separator: int):
    """Arrays of all pieces of a partition: doc_id, and (row, piece, start, length, crc).  Texts are not kept."""
    words, end = _word_ids(path), np.array([separator], "<u4").tobytes()
    ids, rows = [], []
    seen = 0
    for batch in batches:
        ids.append(batch.column(0).take(pa.array(np.arange(batch.num_rows))))  # a copy: the batch can go
        for i, text in enumerate(batch.column(1).cast(pa.binary())):
            data = words.ids(text.as_py() or b"") + end
            for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                rows.append((seen + i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        seen += batch.num_rows
    table = np.array(rows, np.int64).reshape(-1, 5)
    return pa.concat_arrays(ids).take(pa.array(table[:, 0])) if ids else None, table


def _member_type(id_type: pa.DataType) -> list[pa.Field]:
    return [pa.field("doc_id", id_type), pa.field("piece", pa.int32()), pa.field("start", pa.int64()),
            pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64()), pa.field("offset", pa.int64())]


def pack(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         separator: int = 0, slack: int = 16, items_per_task: int = 100_000) -> DataFrame:
    """Pack all rows of ``df``; returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset."""
    ship(df)
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"bin bigint, fill bigint, full boolean, members array<{_MEMBER.format(id=id_type)}>"

    def first_round(batches):
        docs, t = _pieces(batches, tokenizer_path, capacity, separator)
        if not len(t):
            return
        fields = _member_type(docs.type)
        members = pa.StructArray.from_arrays(
            [docs, pa.array(t[:, 1], pa.int32()), *(pa.array(t[:, i], pa.int64()) for i in (2, 3, 4)),
             pa.array(np.zeros(len(t), np.int64))], fields=fields)
        yield _pack(t[:, 3], np.arange(len(t) + 1), members, capacity, slack)

    def next_round(batches):
        fills, counts, parts = [], [], []
        for b in batches:
            fills.append(b.column(0).to_numpy())
            lists = b.column(1)
            counts.append(lists.value_lengths().to_numpy())
            parts.append(lists.flatten())
        if not fills:
            return
        first = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        yield _pack(np.concatenate(fills), first, pa.concat_arrays(parts), capacity, slack)

    def numbered(bins: DataFrame, k: int) -> DataFrame:
        """Bin numbers are unique over rounds and tasks."""
        high = F.lit(k).cast("long") * F.lit(1 << 56)
        task = F.spark_partition_id().cast("long") * F.lit(1 << 30)
        return bins.withColumn("bin", high + task + F.col("bin"))

    source = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    bins = written(numbered(source.mapInArrow(first_round, schema), 0), "pack-0")
    done, k, before = bins.where("full"), 0, None
    while True:
        left = bins.where("not full")
        n = left.count()
        tasks = -(-n // items_per_task)
        # another round helps unless one task has already seen everything, or nothing was joined
        if n <= 1 or before == 1 or (before is not None and n >= seen):
            return _members(done.unionByName(left))
        k, before, seen = k + 1, tasks, n
        dealt = left.select("fill", "members").repartition(tasks, F.xxhash64("bin"))
        bins = written(numbered(dealt.mapInArrow(next_round, schema), k), f"pack-{k}")
        done = done.unionByName(bins.where("full"))


def _members(bins: DataFrame) -> DataFrame:
    one = bins.select("bin", F.explode("members").alias("m"))
    return one.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32",
                      F.col("bin").alias("sequence_id"), "m.offset")
