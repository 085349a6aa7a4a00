"""Language-model scores of texts by a subword lattice.

The vocabulary is an existing one (pieces in order of rank, never trained
here).  A text's tokens are its words (runs without ASCII white space, A-Z in
lower case), then one ``end``.  A word, led by a space, is a lattice of all its
segmentations into pieces; every segmentation weighs the product of its
pieces' probabilities, and the forward recursion in log space gives their sum,
the marginal probability.  As no piece's use crosses a word's start, a text's
log probability is the sum over its words and its end.

1. One pass writes the words of each text with their counts; long texts in
   parts, so that no task holds a whole text's words.
2. Counts of each distinct word, in the learning rows and in all, are grouped
   by Spark and written.  This table grows with the corpus.
3. Piece probabilities: the rank's weight (Zipf's law, one pseudo-count a
   piece) plus expected counts of the pieces in the lattices of all learning
   words, for a few rounds of expectation-maximisation.  Only a number per
   piece reaches the driver.
4. The marginal probability of each distinct word is found once.
5. A bounded table of the most frequent words (by counts in all rows, so that
   no frequent word is left to a join) is sent to the tasks; all other words
   are joined by shuffle.  Nothing is dropped.

Beside the model's score stands a base: add-one probabilities of whole words.

Defined results: null text counts as empty, which has the end alone; rows with
null id are scored, and learnt from as ``learn`` says (null: not); repeated
rows each give their row; without learning rows the base is 0 and the pieces
weigh by rank alone; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import ship, written

#: Longest piece used, in bytes.
LONGEST = 16
#: Words that are sent to all tasks: so many of up to 64 bytes, and so many of up to 4,096 (12 MB at most).
FREQUENT = ((1 << 17, 0, 64), (1 << 10, 64, 4096))


def read_ranks(path: str) -> list[bytes]:
    """Pieces of a ``.tiktoken`` file by rank."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, lines))
    return [piece for _, piece in pairs]


class Lattice:
    """Finds the pieces at every position of many words at once, and sums over segmentations.

    Level ``k`` of the trie holds the sorted keys ``state * 256 + byte`` of all piece beginnings of ``k`` bytes;
    a key's place is the state of the next level.
    """

    def __init__(self, pieces: list[bytes], longest: int = LONGEST):
        self.size = len(pieces)
        own = {p: i for i, p in enumerate(pieces) if 0 < len(p) <= longest}
        for byte in range(256):
            if bytes([byte]) not in own:
                raise ValueError(f"byte {byte} is no piece: some texts could not be segmented")
        self.levels = []
        state = {b"": 0}
        for k in range(1, longest + 1):
            heads = sorted({p[:k] for p in own if len(p) >= k})
            if not heads:
                break
            keys = np.array([state[h[:-1]] * 256 + h[-1] for h in heads], np.int64)
            piece = np.array([own.get(h, -1) for h in heads], np.int32)
            longer = {p[:k] for p in own if len(p) > k}
            self.levels.append((keys, piece, np.array([h in longer for h in heads])))
            state = {h: i for i, h in enumerate(heads)}
        self.width = len(self.levels)

    def pieces_at(self, text: np.ndarray, a: int, b: int) -> np.ndarray:
        """Ids [words, starts a to b, length - 1] of the pieces of equally long words; -1: no piece."""
        n, length = text.shape
        width = min(self.width, length - a)
        ids = np.full((n * (b - a), width), -1, np.int32)
        row, start = np.divmod(np.arange(n * (b - a)), b - a)
        at = row * length + start + a
        left = length - a - start
        flat, here, state = text.reshape(-1), np.arange(len(at)), None
        for k in range(width):
            keys, piece, more = self.levels[k]
            key = flat[at[here] + k].astype(np.int64)
            if state is not None:
                key += state * 256
            place = np.searchsorted(keys, key)
            place[place == len(keys)] = 0
            hit = keys[place] == key
            here, state = here[hit], place[hit]
            ids[here, k] = piece[state]
            on = more[state] & (left[here] > k + 1)
            here, state = here[on], state[on]
            if not len(here):
                break
        return ids.reshape(n, b - a, width)

    def forward(self, text: np.ndarray, logp: np.ndarray, step: int) -> np.ndarray:
        """Log probability of every beginning of each word."""
        n, length = text.shape
        alpha = np.full((n, length + 1), -np.inf)
        alpha[:, 0] = 0
        for a in range(0, length, step):
            ids = self.pieces_at(text, a, min(length, a + step))
            weight = logp[ids]
            for i in range(ids.shape[1]):
                s, w = a + i, min(ids.shape[2], length - a - i)
                part = alpha[:, s + 1 : s + 1 + w]
                np.logaddexp(part, alpha[:, s : s + 1] + weight[:, i, :w], out=part)
        return alpha

    def expected(self, text: np.ndarray, times: np.ndarray, logp: np.ndarray, step: int, out: np.ndarray) -> None:
        """Adds each piece's expected count to ``out``: a backward pass over the forward sums."""
        n, length = text.shape
        alpha = self.forward(text, logp, step)
        rest = alpha[:, -1:].copy()
        beta = np.full((n, length + 1), -np.inf)
        beta[:, -1] = 0
        for a in reversed(range(0, length, step)):
            ids = self.pieces_at(text, a, min(length, a + step))
            weight = logp[ids]
            for i in reversed(range(ids.shape[1])):
                s, w = a + i, min(ids.shape[2], length - a - i)
                weight[:, i, :w] += beta[:, s + 1 : s + 1 + w]
                beta[:, s] = np.logaddexp.reduce(weight[:, i, :w], axis=1)
            row, start, k = np.nonzero(ids >= 0)
            share = np.exp(weight[row, start, k] + alpha[row, start + a] - rest[row, 0])
            out += np.bincount(ids[row, start, k], share * times[row], minlength=len(out))[: len(out)]


def equally_long(words: pa.Array, cells: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Words led by a space as (places in ``words``, bytes [words, length], starts to handle at a time)."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if len(group):
            length = int(size[group[0]])
            many = max(1, cells // (length + 1))
            for i in range(0, len(group), many):
                part = group[i : i + many]
                text = np.full((len(part), length + 1), 32, np.uint8)
                if length < 256:
                    text[:, 1:] = data[offsets[part][:, None] + np.arange(length)]
                else:
                    for row, at in zip(text, offsets[part], strict=True):
                        row[1:] = data[at : at + length]
                yield part, text, max(1, cells // len(part))


class Model:
    """Natural-log probabilities of the pieces, the end's last."""

    def __init__(self, pieces: list[bytes]):
        self.lattice = Lattice(pieces)
        usable = np.array([0 < len(p) <= LONGEST for p in pieces])
        self.prior = usable / (np.arange(len(pieces)) + 2.0)  # Zipf's law over the ranks
        self.prior *= usable.sum() / self.prior.sum()
        self.set(np.zeros(len(pieces)), 0)

    def set(self, counts: np.ndarray, ends: int) -> None:
        """Counts of the pieces and of the ends; the prior is added to them."""
        with np.errstate(divide="ignore"):
            weight = np.append(self.prior + counts, 1 + ends)
            self.logp = np.log(weight / weight.sum())

    def of_pieces(self) -> np.ndarray:
        return np.append(self.logp[:-1], -np.inf)  # id -1: no piece

    @property
    def end(self) -> float:
        return float(self.logp[-1])

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """Natural-log marginal probability of each word."""
        logp, out = self.of_pieces(), np.zeros(len(words))
        for at, text, step in equally_long(words):
            out[at] = self.lattice.forward(text, logp, step)[:, -1]
        return out


def parts_of(text: str | None, size: int = 1 << 20) -> Iterator[bytes]:
    """The text's bytes, A-Z in lower case, cut at white space into parts of about ``size``."""
    data = (text or "").encode().lower()
    a = 0
    while len(data) - a > size:
        b = a + size
        while b < len(data) and data[b] not in b" \t\n\v\f\r":
            b += 1
        yield data[a:b]
        a = b
    yield data[a:] if a else data


COUNTED = "row long, id {id}, learn boolean, first boolean, n long, words array<binary>, times array<long>"


def _counted(many: int = 200_000):
    def run(batches):
        rows: list = [[] for _ in range(7)]
        held = 0

        def batch():
            ids = pa.chunked_array(rows[1]).combine_chunks() if rows[1] else None
            starts = np.cumsum([0, *map(len, rows[5])])
            flat = lambda k, kind: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array([x for r in rows[k] for x in r], kind))
            return pa.RecordBatch.from_arrays([pa.array(rows[0]), ids, pa.array(rows[2], pa.bool_()), pa.array(rows[3]), pa.array(rows[4], pa.int64()),
                                               flat(5, pa.binary()), flat(6, pa.int64())], ["row", "id", "learn", "first", "n", "words", "times"])

        for b in batches:
            row, ids, learn, texts = b.columns
            for i in range(b.num_rows):
                for first, part in enumerate(parts_of(texts[i].as_py())):
                    found = Counter(part.split())
                    for k, v in enumerate((row[i].as_py(), ids.slice(i, 1), learn[i].as_py(), first == 0, found.total(), list(found), list(found.values()))):
                        rows[k].append(v)
                    held += len(found)
                    if held >= many:
                        yield batch()
                        rows, held = [[] for _ in range(7)], 0
        if rows[0]:
            yield batch()

    return run


def count_words(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: a row for each text's part with its words, and one for each distinct word with its counts."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    # the number is made once, as the table is written
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"),
                       F.col(text_col).alias("text"))
    texts = written(rows.mapInArrow(_counted(), COUNTED.format(id=kind)), "lm-texts")
    each = texts.select("learn", F.explode(F.arrays_zip("words", "times")).alias("w"))
    return texts, written(each.groupBy(F.col("w.words").alias("word")).agg(
        F.sum(F.when(F.col("learn"), F.col("w.times")).otherwise(0)).alias("c"), F.sum("w.times").alias("all")), "lm-words")


def binary(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.binary()) if column.type != pa.binary() else column


def fit(words: DataFrame, model: Model, ends: int, rounds: int) -> Model:
    """Rounds of expectation-maximisation over all distinct learning words."""
    spark = words.sparkSession
    learnt = words.where("c > 0").select("word", "c")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)  # the vocabulary and a number a piece

        def expected(batches, sent=sent):
            now = sent.value
            logp, out, some = now.of_pieces(), np.zeros(now.lattice.size), False
            for b in batches:
                times, some = b.column(1).to_numpy(), True
                for at, text, step in equally_long(binary(b.column(0))):
                    now.lattice.expected(text, times[at].astype(float), logp, step, out)
            if some:
                ids = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out[ids])], ["piece", "n"])

        sums = learnt.mapInArrow(expected, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row a piece at most
        counts = np.zeros(model.lattice.size)
        for r in sums:
            counts[r["piece"]] = r["n"]
        model.set(counts, ends)
    return model


def frequent(words: DataFrame) -> dict:
    """The most frequent words with their numbers, as arrays; bounded in rows and bytes (FREQUENT)."""
    found = None
    for most, longer, upto in FREQUENT:
        part = words.where(F.length("word").between(longer + bool(longer), upto)).orderBy(F.desc("all"), "word").limit(most)
        found = part if found is None else found.unionByName(part)
    got = found.select("word", "c", "logp").toArrow()
    return {"word": binary(got.column("word")), "c": got.column("c").to_numpy(), "logp": got.column("logp").to_numpy()}


def score(docs: DataFrame, pieces: list[bytes], learn: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """A row for each document: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (both log10).

    ``learn`` is true for the rows that counts and probabilities are learnt from.
    """
    spark = ship(docs)
    texts, words = count_words(docs, learn, id_col, text_col)
    total = words.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).first()
    ends = texts.where("learn AND first").count()
    tokens, distinct = (total["n"] or 0) + ends, (total["v"] or 0) + bool(ends)
    model = fit(words, Model(pieces), ends, rounds)
    known = float(tokens + distinct + 1)
    sent = spark.sparkContext.broadcast(model)

    def marginal(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.word_scores(binary(b.column(0))))], ["word", "c", "all", "logp"])

    words = written(words.mapInArrow(marginal, "word binary, c long, all long, logp double"), "lm-scored")
    top = spark.sparkContext.broadcast(frequent(words))

    def scored(batches):
        table = top.value
        for b in batches:
            lists, times = b.column("words"), b.column("times").flatten().to_numpy()
            flat = binary(lists.flatten())
            row = np.repeat(np.arange(len(b)), pc.list_value_length(lists).to_numpy())
            place = pc.fill_null(pc.index_in(flat, value_set=table["word"]), -1).to_numpy()
            rare = place < 0
            at, here, n = place[~rare], row[~rare], times[~rare]
            sums = [np.bincount(here, x, minlength=len(b)).astype(float) for x in (
                n * (table["c"][at] > 0), n * np.log10((table["c"][at] + 1) / known), n * table["logp"][at] / np.log(10))]
            starts = pa.array(np.append(0, np.cumsum(np.bincount(row[rare], minlength=len(b)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("id"), b.column("first"), b.column("n"), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                 pa.ListArray.from_arrays(starts, flat.filter(pa.array(rare))), pa.ListArray.from_arrays(starts, pa.array(times[rare]))],
                ["row", "id", "first", "n", "n_known", "base", "score", "words", "times"])

    kind = dict(texts.dtypes)["id"]
    part = written(texts.select("row", "id", "first", "n", "words", "times").mapInArrow(
        scored, f"row long, id {kind}, first boolean, n long, n_known long, base double, score double, words array<binary>, times array<long>"), "lm-parts")
    rare = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    n, c = F.col("n"), F.col("c")
    joined = rare.join(words.select("word", "c", "logp"), "word").groupBy("row").agg(
        F.sum(F.when(c > 0, n).otherwise(0)).alias("n_known"), F.sum(n * F.log10((c + 1) / F.lit(known))).alias("base"),
        F.sum(n * F.col("logp") / F.lit(float(np.log(10)))).alias("score"))
    both = part.select("row", "id", "first", "n", "n_known", "base", "score").unionByName(joined, allowMissingColumns=True)
    end_known = int(ends > 0)
    end_base = float(np.log10((ends + 1) / known))
    out = both.groupBy("row").agg(F.max(F.when(F.col("first"), F.col("id"))).alias(id_col), F.sum("n").alias("n"),
                                  F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    return out.select(id_col, (F.col("n") + 1).alias("n_tokens"), (F.col("n_known") + end_known).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
                      (F.col("base") + end_base).alias("base_score"), (F.col("score") + model.end / float(np.log(10))).alias("score"))
