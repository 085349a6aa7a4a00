"""Language identification by multilingual mixture inference.

Training: byte trigrams of lower-cased words, hashed to ``2**bits`` codes,
counted per language over all labelled rows; the counts (a table of fixed
size per language) give smoothed trigram likelihoods.  Inference: expectation
maximisation estimates the proportions of all languages in one document;
languages with less than ``min_share`` leave, and further ones leave as long
as the penalised likelihood (a BIC term per language; trigrams overlap, so
each counts a third) gets better.  The prediction is the largest of the
selected set, the score its proportion.

Defined results: ``und`` with score 0 for null texts and texts without a
letter (number signs such as a fraction, a raised two or a circled one are no letters); with no training rows every text is ``und``.  Repeated and very long
texts are whole documents like any other; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import ship, values

#: Runs that may hold letters; digits of all kinds, fractions and number signs among them are none.
MAYBE_LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: ASCII bytes that are not letters count as a space.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def has_letter(text: str) -> bool:
    return any(c.isalpha() for run in MAYBE_LETTERS.finditer(text) for c in run[0])


@dataclass
class Model:
    languages: list[str]
    probs: np.ndarray  # codes x languages
    bits: int
    min_share: float
    penalty: float


def codes(data: np.ndarray, bits: int) -> np.ndarray:
    """Hashed trigrams of UTF-8 bytes, those with two spaces left out."""
    b = _FOLD[data]
    blank = b == 0x20
    keep = ~((blank[:-2] & blank[1:-1]) | (blank[1:-1] & blank[2:]))
    packed = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:])[keep]
    return (packed * np.uint32(2654435761)) >> np.uint32(32 - bits)


def histogram(text: str, bits: int, piece: int = 1 << 20) -> np.ndarray:
    """Counts of all codes of a whole text, taken piece by piece."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    total = np.zeros(1 << bits, np.int64)
    for at in range(0, len(data) - 2, piece):
        found = np.bincount(codes(data[at : at + piece + 2], bits))
        total[: len(found)] += found
    return total


def train(df: DataFrame, *, text_col: str = "text", label_col: str = "lang", bits: int = 15, smoothing: float = 0.5,
          min_share: float = 0.02, penalty: float = 1.0, max_languages: int = 1000) -> Model:
    """Learn from all rows of ``df`` with a label and a text."""
    ship(df)
    size = 1 << bits

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), values(batch.column(1)), strict=True):
                if label not in sums:
                    sums[label] = np.zeros(size, np.int64)
                sums[label] += histogram(text, bits)
        for label, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(at)), pa.array(at, pa.int64()), pa.array(total[at])], names=["l", "c", "n"])

    labelled = df.select(F.col(label_col).cast("string").alias("l"), F.col(text_col).alias("t")).dropna()
    counted = labelled.mapInArrow(count, "l string, c bigint, n bigint").groupBy("l", "c").agg(F.sum("n").alias("n"))
    by_language = (counted.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("c", "n"))).alias("x"))
                   .orderBy("l").limit(max_languages + 1).toArrow())
    languages = by_language.column("l").to_pylist()
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} labels")
    probs = np.full((size, len(languages)), smoothing)
    for k, pairs in enumerate(by_language.column("x")):
        s = pairs.values
        probs[s.field("c").to_numpy(), k] += s.field("n").to_numpy()
    return Model(languages, probs / probs.sum(axis=0), bits, min_share, penalty)


def _em(a: np.ndarray, counts: np.ndarray, total: float, share: np.ndarray) -> tuple[np.ndarray, float]:
    for _ in range(40):
        mixture = a @ share
        new = share * ((counts / mixture) @ a) / total
        done = np.abs(new - share).max() < 1e-3
        share = new
        if done:
            break
    return share, float(counts @ np.log(a @ share))


def mixture(text: str | None, model: Model) -> dict[str, float]:
    """Selected languages of a text and their proportions; empty if it has no letter."""
    if not text or not model.languages or not has_letter(text):
        return {}
    hist = histogram(text, model.bits)
    at = np.flatnonzero(hist)
    counts = hist[at].astype(float)
    total = counts.sum()
    if not total:
        return {}
    a = model.probs[at]
    chosen = np.arange(len(model.languages))
    share, like = _em(a, counts, total, np.full(len(chosen), 1 / len(chosen)))
    fee = model.penalty * 0.5 * np.log(total) * 3
    while len(chosen) > 1:
        keep = share >= model.min_share
        if keep.all():  # all are large: does the penalised likelihood want the smallest?
            keep[np.argmin(share)] = False
            some, less = _em(a[:, keep], counts, total, share[keep] / share[keep].sum())
            if less + fee * (len(chosen) - keep.sum()) < like:
                break
        else:
            if not keep.any():
                keep[np.argmax(share)] = True
            some, less = _em(a[:, keep], counts, total, share[keep] / share[keep].sum())
        a, chosen, share, like = np.ascontiguousarray(a[:, keep]), chosen[keep], some, less
    return {model.languages[k]: min(1.0, float(s)) for k, s in zip(chosen, share, strict=True)}


def predicted(text: Column, model: Model) -> Column:
    """Column struct<lang, score, mixture> for a text column.  The model's size is fixed by its
    parameters, never by the corpus."""
    shared = text_model(model)

    @F.arrow_udf("struct<lang:string,score:double,mixture:map<string,double>>")
    def identify(texts: pa.Array) -> pa.Array:
        m = shared.value
        found = [mixture(t, m) for t in values(texts)]
        best = [max(sorted(f), key=f.get) if f else UNDETERMINED for f in found]
        score = [f[b] if f else 0.0 for f, b in zip(found, best, strict=True)]
        return pa.StructArray.from_arrays(
            [pa.array(best, pa.string()), pa.array(score, pa.float64()),
             pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))],
            names=["lang", "score", "mixture"])

    return identify.asNondeterministic()(text)


def text_model(model: Model):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().sparkContext.broadcast(model)
