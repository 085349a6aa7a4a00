"""Benchmark decontamination: BM25 with block-max WAND, then question and answer overlap.

Test items form an inverted index: per word its items with BM25 impacts, and
per block of items the largest impact.  Impacts are divided by the item's score
against itself, so a passage scores 1 if it has every word of the item, and
one threshold serves items of any length.

Every training text is cut into passages of twice the longest item's words,
half overlapping, so each item would lie within one whole passage.  Each
passage queries the index for all items at or above the threshold: a bound
from its words' largest impacts first, then block-max WAND.  A retrieved item
counts as a leak if enough of its question's and of its answer's word
sequences stand in the passage.  The answer is the item's last sentence (its
last quarter, if it has one sentence only).

Scale: document frequencies are counted over all items; the index is built in
shards of at most ``shard_items`` items, so what is sent to the executors is
bounded by that parameter, and every text queries every shard (one scan of
the texts for each shard).

Defined results: null and empty texts or items match nothing; ids have any
type, null ones are carried; repeated items are reported each; a text that holds an item several times reports its best
passage; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._work import ship, values, written

WORD = re.compile(r"\w+")
#: Widely used BM25 parameters.
K1, B = 1.2, 0.75
#: Passages of a long text are scored in groups of this many (passage, item) cells.
CELLS = 1 << 20
HIT = "array<struct<item:{item},passage:bigint,score:double,question:double,answer:double>>"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and of its answer."""
    sentences = [w for w in map(words_of, re.split(r"(?<=[.?!])\s+", text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


@dataclass
class Index:
    """Inverted index.  Blocks are ranges of item numbers, the same for every word."""

    items: list
    sides: list[tuple[list[str], list[str]]]
    vocabulary: dict[str, int]
    passage: int
    block: int
    top: np.ndarray  # largest impact of each word
    starts: np.ndarray  # of a word's postings
    item: np.ndarray
    impact: np.ndarray
    block_starts: np.ndarray  # of a word's blocks
    block_of: np.ndarray
    block_rows: np.ndarray  # first posting of each word's block
    block_top: np.ndarray  # largest impact of the word in the block
    id_type: T.DataType = T.LongType()


def build(items: list, texts: list[str], df: dict[str, int], n_items: int, mean_words: float, longest: int, block: int) -> Index:
    """Index of some items under the statistics of all items."""
    vocabulary: dict[str, int] = {}
    rows: list[tuple[int, int, float]] = []
    for i, text in enumerate(texts):
        words = words_of(text)
        counts: dict[str, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        norm = K1 * (1 - B + B * len(words) / max(mean_words, 1e-9))
        impact = {w: np.log1p((n_items - df[w] + 0.5) / (df[w] + 0.5)) * c * (K1 + 1) / (c + norm) for w, c in counts.items()}
        own = sum(impact.values())
        rows += [(vocabulary.setdefault(w, len(vocabulary)), i, float(x / own)) for w, x in impact.items()]
    rows.sort()
    word, item = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    impact = np.array([r[2] for r in rows])
    n = len(vocabulary)
    first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (item[1:] // block != item[:-1] // block)]) if len(rows) else np.zeros(0, np.int64)
    starts = np.searchsorted(word, np.arange(n + 1))
    return Index(items, [question_answer(t) for t in texts], vocabulary, max(64, 2 * longest), block,
                 np.maximum.reduceat(impact, starts[:-1]) if n else np.zeros(0), starts, item, impact,
                 np.searchsorted(word[first], np.arange(n + 1)), item[first] // block, np.r_[first, len(rows)],
                 np.maximum.reduceat(impact, first) if len(first) else np.zeros(0))


def _expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each term in a table sorted by term, and for each such row the place of its term in ``terms``."""
    size = starts[terms + 1] - starts[terms]
    of = np.repeat(np.arange(len(terms)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[terms], size), of


def block_max_wand(index: Index, passage: np.ndarray, term: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """All (passage, item, score) with a score of ``least`` or more, for passages given as their distinct terms.

    Document-at-a-time WAND looks only at items from the pivot word on; here
    that is done for all items of a block at once.  A passage's words, weakest
    first, cannot reach the threshold before its pivot, so an item needs a word
    from the pivot on.  Blocks are ruled out by the block maxima of those words
    and the total of the weaker ones; then by the block maxima of all words;
    only what is left is scored.
    """
    least = least - 1e-9
    order = np.lexsort((index.top[term], passage))
    passage, term = passage[order], term[order]
    top = index.top[term]
    total = np.cumsum(top)
    first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    size = np.diff(np.r_[first, len(passage)])
    so_far = total - np.repeat(total[first] - top[first], size)
    strong = so_far >= least  # the pivot and the words after it
    weak = np.bincount(passage, np.where(strong, 0.0, top))
    p, t = passage[strong], term[strong]
    at, of = _expand(index.block_starts, t)
    blocks = int(index.block_of.max(initial=0)) + 1
    n = int(passage[-1]) + 1
    bound = np.bincount(p[of] * blocks + index.block_of[at], index.block_top[at], n * blocks).reshape(n, blocks)
    open_blocks = bound + weak[:, None] >= least
    able = open_blocks.any(axis=1)[passage]
    passage, term = passage[able], term[able]
    at, of = _expand(index.block_starts, term)
    p = passage[of]
    open_here = open_blocks[p, index.block_of[at]]
    p, at, of = p[open_here], at[open_here], of[open_here]
    bound = np.bincount(p * blocks + index.block_of[at], index.block_top[at], n * blocks).reshape(n, blocks)
    open_blocks = bound >= least
    keep = open_blocks[p, index.block_of[at]]
    p, at = p[keep], at[keep]
    if not len(p):
        return []
    # postings of the blocks that are left
    rows, of = _expand(index.block_rows, at)
    items = len(index.items)
    score = np.bincount(p[of] * items + index.item[rows], index.impact[rows], n * items)
    return [(int(k) // items, int(k) % items, float(score[k])) for k in np.flatnonzero(score >= least)]


def _overlap(part: list[str], grams: dict[int, set], words: list[str], size: int = 3) -> float:
    """Share of the part's word sequences (of ``size``, or all its words if fewer) that stand among the words."""
    if not part:
        return 1.0
    size = min(size, len(part))
    if size not in grams:
        grams[size] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
    own = {tuple(part[i : i + size]) for i in range(len(part) - size + 1)}
    return len(own & grams[size]) / len(own)


def leaks(text: str | None, index: Index, least: float, question: float, answer: float) -> list[dict]:
    """Items that leak into a text, each with its best passage."""
    words = words_of(text)
    if not words or not index.vocabulary:
        return []
    get = index.vocabulary.get
    ids = np.array([get(w, -1) for w in words], np.int64)
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        return []
    term = ids[at]
    order = np.argsort(term, kind="stable")
    before = np.full(len(at), -1, np.int64)  # place of the word's occurrence before this one
    again = term[order][1:] == term[order][:-1]
    before[order[1:][again]] = at[order[:-1][again]]
    stride = index.passage // 2
    n = max(1, -(-(len(words) - stride) // stride))
    parts = []
    for back in (0, 1):
        p = at // stride - back
        counts = (p >= 0) & (p < n) & (before < p * stride)  # a word's first occurrence in passage p
        parts.append((p[counts], term[counts]))
    passage, term = (np.concatenate(x) for x in zip(*parts, strict=True))
    able = np.bincount(passage, index.top[term], n) >= least - 1e-6
    passage, term = passage[able[passage]], term[able[passage]]
    if not len(passage):
        return []
    order = np.argsort(passage, kind="stable")
    passage, term = passage[order], term[order]
    step = max(1, CELLS // len(index.items))
    best: dict[int, dict] = {}
    for low in range(0, n, step):
        a, b = np.searchsorted(passage, [low, low + step])
        if a == b:
            continue
        shown: dict[int, tuple[list[str], dict]] = {}
        for p, item, score in block_max_wand(index, passage[a:b] - low, term[a:b], least):
            at = (low + p) * stride
            inside, grams = shown.setdefault(p, (words[at : at + index.passage], {}))
            q, a_share = (_overlap(side, grams, inside) for side in index.sides[item])
            if q >= question and a_share >= answer and score > best.get(item, {"score": -1.0})["score"]:
                best[item] = {"item": item, "passage": at, "score": score, "question": q, "answer": a_share}
    return [best[i] for i in sorted(best)]


def indexes(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", shard_items: int = 20_000, block: int = 8):
    """The index shards of a table of test items, one after the other."""
    ship(items)
    rows = items.select(F.col(id_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    worded = written(rows.withColumn("words", _split("text")), "benchmark-words")
    n, mean, longest = worded.agg(F.count("*"), F.avg(F.size("words")), F.max(F.size("words"))).first()
    shards = max(1, -(-n // shard_items))
    # equal texts get different shards by their id, so a shard's share is even
    worded = worded.withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.lit(shards)))
    counted = worded.select("shard", F.explode(F.array_distinct("words")).alias("w"))
    df = counted.groupBy("w").agg(F.count("*").alias("df"))
    for k in range(shards if n else 0):
        own = worded.where(F.col("shard") == k).select("item", "text").orderBy("item", "text").toArrow().to_pydict()
        terms = df.join(counted.where(F.col("shard") == k).select("w").distinct(), "w").toArrow().to_pydict()
        index = build(own["item"], own["text"], dict(zip(terms["w"], terms["df"], strict=True)), n, mean or 0.0, longest or 0, block)
        yield replace(index, id_type=rows.schema["item"].dataType)


def _split(text: str) -> Column:
    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([words_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return split(text)


def leaked(text: Column, index: Index, *, least: float = 0.6, question: float = 0.5, answer: float = 0.5) -> Column:
    """Column: the items of one index shard that leak into a text (``item`` is the item's id)."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(index)

    @F.arrow_udf(HIT.format(item=index.id_type.simpleString()))
    def find(texts: pa.Array) -> pa.Array:
        ix = shared.value
        rows = [leaks(t, ix, least, question, answer) for t in values(texts)]
        for row in rows:
            for hit in row:
                hit["item"] = ix.items[hit["item"]]
        kind = pa.struct([("item", to_arrow_type(ix.id_type)), ("passage", pa.int64()), ("score", pa.float64()),
                          ("question", pa.float64()), ("answer", pa.float64())])
        return pa.array(rows, pa.list_(kind))

    return find.asNondeterministic()(text)


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **params) -> DataFrame:
    """A row per (document, leaked item): doc_id, item_id, passage (its first word's place), score,
    question_overlap, answer_overlap."""
    ship(docs)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in indexes(items, id_col=item_col):
        hits = source.select("doc_id", leaked(F.col("text"), index, **params).alias("hits"))
        hits = hits.select("doc_id", F.explode("hits").alias("h")).select(
            "doc_id", F.col("h.item").alias("item_id"), "h.passage", "h.score",
            F.col("h.question").alias("question_overlap"), F.col("h.answer").alias("answer_overlap"))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        kind = items.schema[item_col].dataType.simpleString()
        out = source.where("false").selectExpr("doc_id", f"CAST(NULL AS {kind}) item_id", "0L passage", "0D score", "0D question_overlap", "0D answer_overlap")
    return out


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the rows whose text holds a leaked item; all columns kept."""
    ship(docs)
    out, mark = docs, "leaks_of_decontamination_stage"
    for index in indexes(items):
        out = out.withColumn(mark, leaked(F.col(text_col), index, **params)).where(F.size(mark) == 0).drop(mark)
    return out
