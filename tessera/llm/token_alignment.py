"""Cross-tokenizer alignment: groups and links between the tokens of two tokenizers.

Tokenizer A sees a space and the text, tokenizer B the text (it adds the space
itself).  Each side's tokens get the byte offsets at which they end, in a
dictionary from end to index; the ends that both dictionaries hold, sorted, cut
both id lists into groups, and the tokens that end together there are linked.

A text is handled unit by unit: it is cut before every single space that stands
between two characters that are no white space.  No token of either tokenizer
reaches over such a place (no piece holds one; this is looked up), so a unit's
tokens are the text's.  The distinct units of some megabytes of text are encoded
and aligned together, as arrays; texts are put together from them.

Counts over the corpus: a written table holds each text's links (id pair and
times).  Spark sums them per pair.  The most frequent pairs go to every task as
a bounded table; the others are joined by shuffle, so that no frequent pair
meets in one task and nothing is dropped.

Defined results: null and empty texts, and texts whose tokens of A or B do not
spell the space and the text, have no tokens: zeros and an empty digest; rows
with null id and repeated rows each give their row and count like any other; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import ship, values, written

#: What byte-level vocabularies of this kind take for one pre-token.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the mark that stands for a space in B's pieces.
MARK = "\u2581"
#: A single space between characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Most frequent pairs that are sent to all tasks (17 bytes each).
FREQUENT = 1 << 18


def byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """A vocabulary's pieces: byte lengths, and the bytes of any id list."""

    def __init__(self, pieces: list[bytes]):
        for piece in pieces:
            if not piece or CUT.search(piece.decode(errors="ignore")):
                raise ValueError(f"piece {piece!r} is empty or holds a place where texts are cut")
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.digits, self.width = decimals(len(pieces))

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.repeat(self.start[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, to the left, with room for a sign behind them; and their number."""
    text = np.arange(n).astype("S")
    width = np.char.str_len(text)
    return np.pad(text.view(np.uint8).reshape(n, -1), ((0, 0), (0, 1))), width.astype(np.int64)


class Encoders:
    """Both tokenizers; one a worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back = byte_of_character()
        special = [t for t in model["vocab"] if not all(c in back for c in t)]
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"][m.replace(" ", "") if isinstance(m, str) else "".join(m)] for m in model["merges"]]
        if special or merged != sorted(merged) or len(ranks) != len(model["vocab"]):
            raise ValueError("the ids of A's vocabulary do not follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [b"?"] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        self.a_tokens = Tokens(pieces)
        names = map(self.b.id_to_piece, range(self.b.vocab_size()))
        self.b_tokens = Tokens([bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace(MARK, " ").encode() for n in names])

    def encoded(self, units: list[str], odd: set[str]):
        """Ids of A and of B over all units, each led by its space; None: B spells some of them otherwise."""
        # white space at a unit's end would run into the next one's space: such units (``odd``) stand alone
        parts, plain = [], []
        for u in units:
            plain.append(u)
            if u in odd or len(plain) >= 256:
                parts.append(" ".join(plain))
                plain = []
        parts += [" ".join(plain)] if plain else []
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (
            [self.a.encode_ordinary(" " + p) for p in parts], self.b.encode(parts, num_threads=1)))
        data = np.frombuffer("".join([" " + p for p in parts]).encode(), np.uint8)
        same = len(data) == self.b_tokens.size[b].sum() == self.a_tokens.size[a].sum()
        if not same or (self.b_tokens.spelled(b) != data).any() or (self.a_tokens.spelled(a) != data).any():
            return None
        return a, b

    def aligned(self, units: list[str], odd: set[str]) -> tuple[np.ndarray, "Aligned"]:
        """All units at once, and the place of each among them; those that cannot be spelled are left out (-1)."""
        some = [u for u in units if MARK not in u]  # B spells its mark as a space
        got = self.encoded(some, odd)
        if got is None:
            some = [u for u in some if self.encoded([u], odd) is not None]
            got = self.encoded(some, odd)
        if len(some) == len(units):
            place = np.arange(len(units))
        else:
            at = {u: i for i, u in enumerate(some)}
            place = np.array([at.get(u, -1) for u in units], np.int64)
        return place, Aligned(*got, some, self.a_tokens, self.b_tokens)


class Aligned:
    """Groups and links of distinct units: ends of A in a dictionary (by byte) to their index, met by those of B."""

    def __init__(self, a: np.ndarray, b: np.ndarray, units: list[str], a_tokens: Tokens, b_tokens: Tokens):
        size = np.array([len(u) if u.isascii() else len(u.encode()) for u in units], np.int64) + 1
        unit_ends = np.cumsum(size)
        ends_a, ends_b = np.cumsum(a_tokens.size[a]), np.cumsum(b_tokens.size[b])
        index = np.full(int(size.sum()) + 1, -1, np.int64)
        index[ends_a] = np.arange(len(a))
        common_b = np.flatnonzero(index[ends_b] >= 0)
        common_a, ends = index[ends_b[common_b]], ends_b[common_b]
        self.links = a[common_a] << 32 | b[common_b]
        per_unit = lambda last: np.diff(last + 1, prepend=0)
        self.n_groups = np.diff(np.searchsorted(ends, unit_ends, "right"), prepend=0)
        self.first_link = np.cumsum(self.n_groups) - self.n_groups
        self.n_a = per_unit(index[unit_ends])
        last_b = np.searchsorted(ends_b, unit_ends)
        self.n_b = per_unit(last_b)
        # the groups' texts: the ids of A, then those of B, each with the sign behind it
        group_a, group_b = np.searchsorted(common_a, np.arange(len(a))), np.searchsorted(common_b, np.arange(len(b)))
        place_a = np.arange(len(a)) + np.append(0, common_b + 1)[group_a]
        place_b = np.arange(len(b)) + common_a[group_b] + 1
        cells = np.zeros((len(a) + len(b), max(a_tokens.digits.shape[1], b_tokens.digits.shape[1])), np.uint8)
        cells[place_a, : a_tokens.digits.shape[1]] = a_tokens.digits[a]
        cells[place_b, : b_tokens.digits.shape[1]] = b_tokens.digits[b]
        width = np.empty(len(cells), np.int64)
        width[place_a], width[place_b] = a_tokens.width[a], b_tokens.width[b]
        sign = np.full(len(cells), ord(","), np.uint8)
        sign[place_a[common_a]], sign[place_b[common_b]] = ord("|"), ord(";")
        cells[np.arange(len(cells)), width] = sign
        text = cells[cells > 0].tobytes()
        to = np.cumsum(width + 1)[place_b[last_b]].tolist() if units else []
        self.texts = [text[s : e - 1] for s, e in zip([0, *to], to, strict=False)]


def pieces_of(text: str, size: int):
    """Lists of units, each of about ``size`` characters of the text."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield CUT.split(text[at : cut.start()])
        at = cut.end()
    yield CUT.split(text[at:] if at else text)


class Found:
    """What is known of one text so far."""

    def __init__(self):
        self.counts, self.digest, self.pairs, self.times, self.sound = np.zeros(4, np.int64), hashlib.sha256(), [], [], True

    def row(self):
        if not self.sound or not self.counts[0]:
            none = np.zeros(0, np.int64)
            return 0, 0, 0, 0, "", none, none
        pairs, times = np.concatenate(self.pairs), np.concatenate(self.times)
        if len(self.pairs) > 1:
            pairs, back = np.unique(pairs, return_inverse=True)
            times = np.bincount(back, times).astype(np.int64)
        return *self.counts.tolist(), self.digest.hexdigest(), pairs, times


def settle(encoders: Encoders, held: list[tuple[Found, list[str]]]) -> None:
    """Encode and align the distinct units of some pieces together, and add each piece to its text."""
    number: dict[str, int] = {}
    seqs = [np.array([number.setdefault(u, len(number)) for u in units], np.int64) for _, units in held]
    place, al = encoders.aligned(list(number), {units[-1] for _, units in held if units[-1].isspace() or units[-1][-1].isspace()})
    kept = []
    for (f, _), s in zip(held, seqs, strict=True):
        s = place[s]
        f.sound &= bool((s >= 0).all())
        if f.sound:
            kept.append((f, s))
    if not kept:
        return
    held, seq = kept, np.concatenate([s for _, s in kept])
    piece = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
    pairs, of_link = np.unique(al.links, return_inverse=True)
    n = al.n_groups[seq]
    link = of_link[np.repeat(al.first_link[seq] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    key, times = np.unique(np.repeat(piece, n) * len(pairs) + link, return_counts=True)
    cut = np.searchsorted(key, np.arange(len(held) + 1) * len(pairs))
    sums = [np.bincount(piece, x[seq], len(held)).astype(np.int64) for x in (al.n_a, al.n_b, al.n_groups)]
    for k, (f, units) in enumerate(held):
        f.digest.update((b";" if f.counts[0] else b"") + b";".join([al.texts[u] for u in units.tolist()]))
        f.counts += [sums[0][k], sums[1][k], sums[2][k], sums[2][k]]  # a group's last tokens end together: a link a group
        f.pairs.append(pairs[key[cut[k] : cut[k + 1]] % len(pairs)])
        f.times.append(times[cut[k] : cut[k + 1]])


def all_aligned(encoders: Encoders, texts, size: int = 6 << 20):
    """(n_a, n_b, n_groups, n_links, digest, pairs, times) of each text; about ``size`` characters are held at a time."""
    waiting: list[Found] = []
    held: list = []
    total = 0
    for text in texts:
        waiting.append(Found())
        for units in pieces_of(text, size) if text else ():
            held.append((waiting[-1], units))
            total += sum(map(len, units)) + len(units)
            if total >= size:
                settle(encoders, held)
                held, total = [], 0
        if not held:
            yield from (f.row() for f in waiting)
            waiting = []
    if held:
        settle(encoders, held)
    yield from (f.row() for f in waiting)


COUNTS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _links(a_path: str, b_path: str, many: int = 200_000):
    held: list = []

    def run(batches):
        if not held:
            held.append(Encoders(a_path, b_path))
        for batch in batches:
            rows, ids, texts = batch.columns
            begin, out, pairs, times, sizes = 0, [], [], [], []
            for i, (*counts, own, often) in enumerate(all_aligned(held[0], values(texts))):
                out.append(counts)
                pairs.append(own)
                times.append(often)
                sizes.append(len(own))
                if i == batch.num_rows - 1 or sum(sizes) >= many:
                    n = i + 1 - begin
                    starts = pa.array(np.cumsum([0, *sizes]), pa.int32())
                    lists = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate(x))) for x in (pairs, times)]
                    counts = [pa.array(x, pa.string() if k == 4 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))]
                    yield pa.RecordBatch.from_arrays([rows.slice(begin, n), ids.slice(begin, n), *counts, *lists],
                                                     ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                    begin, out, pairs, times, sizes = i + 1, [], [], [], []

    return run


def pair_counts(links: DataFrame) -> DataFrame:
    """Written table: every id pair's count over the corpus, and whether no pair of its B id has more."""
    each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = written(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")), "pair-counts")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = counts.groupBy(of_b).agg(F.max("n").alias("most"))  # a row for each B id
    return written(counts.withColumn("b", of_b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def align_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """A row for each document: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``."""
    spark = ship(docs)
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    # the number is made once, as the table is written
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    links = written(rows.mapInArrow(_links(a_path, b_path), f"row long, id {kind}, {COUNTS}, pairs array<long>, times array<long>"), "token-links")
    counts = pair_counts(links)
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast([top.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in ("pair", "n", "best")])

    def looked_up(batches):
        pair, n, best = sent.value
        for b in batches:
            lists = b.column("pairs")
            size = np.diff(lists.offsets.to_numpy())
            keys, times = lists.flatten().to_numpy(), b.column("times").flatten().to_numpy()
            row = np.repeat(np.arange(len(b)), size)
            place = np.minimum(np.searchsorted(pair, keys), max(0, len(pair) - 1))
            hit = pair[place] == keys if len(pair) else np.zeros(len(keys), bool)
            at = place[hit]
            n_best, count_sum = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)  # integer sums: exact
            np.add.at(n_best, row[hit], times[hit] * best[at])
            np.add.at(count_sum, row[hit], times[hit] * n[at])
            starts = pa.array(np.append(0, np.cumsum(np.bincount(row[~hit], minlength=len(b)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:7], pa.array(n_best), pa.array(count_sum), *(pa.ListArray.from_arrays(starts, pa.array(x[~hit])) for x in (keys, times))],
                [*b.schema.names[:7], "n_best", "count_sum", "pairs", "times"])

    part = written(links.mapInArrow(looked_up, f"row long, id {kind}, {COUNTS}, n_best long, count_sum long, pairs array<long>, times array<long>"), "token-parts")
    rare = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    more = rare.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                                        F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = part.drop("pairs", "times").join(more, "row", "left")
    added = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", added("n_best", "more_best"), added("count_sum", "more_sum"), "groups_sha256")
