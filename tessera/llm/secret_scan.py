"""Secret scans: fixed patterns plus a randomness test battery.

Patterns find assignments, access keys and hexadecimal strings.  Besides,
every token of ``min_length`` or more key characters is tested:

* its encoding is inferred: the smallest alphabet that holds it; besides the
  whole, its parts between '=' and the signs outside an encoding are tested
  (a name before a key, a key in a path), each as a token of its own, and of
  parts that overlap the one with the smallest p-value stands;
* three tests ask whether it is random in that encoding: chi-squared
  uniformity over eight parts of the alphabet, the runs test about the
  alphabet's middle, and the lag-one serial correlation.  A token that any of
  them rejects (Bonferroni, ``reject``) is not random;
* its p-value as ordinary text is twice the smaller of two, and 1 if it is not
  random: the chance that text of the same length changes so often between
  lower case, upper case, digits and marks (binomial with rate ``text_rate``);
  and the likelihood of its pairs of neighbours, case aside, by the pairs
  counted over the corpus, over that of random characters of its encoding.  A
  ratio as small has no larger chance in text (Markov's inequality), whatever
  the length, so short tokens need more.  Without a ``model`` of the corpus
  only the first is used.  Digits follow each other in ordinary numbers nearly
  as in random ones: keys of digits alone have large p-values.

Over all tokens of the corpus the Benjamini-Hochberg rule at level ``fdr``
picks the p-value below which tokens are reported, as kind ``random``.  The
corpus is summed up in a histogram of fixed size for that.

Defined results: null text counts as empty; equal texts give equal spans; an
empty table gives no rows; spans are code points, end exclusive; other columns
are not read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import ship, values

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
TOKEN = "[A-Za-z0-9+/_=-]"
#: Parts of a token in encodings with all signs, with '-_', with '+/' and with none; padding stays at the end.
PARTS = [re.compile(f"[A-Za-z0-9{signs}]+(?:=+$)?") for signs in ("+/_-", "_-", "+/", "")]

_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = [_DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOW, _UP, _UP + "234567", _DIGITS + _LOW, _DIGITS + _UP,
             _UP + _LOW, _DIGITS + _UP + _LOW, _UP + _LOW + _DIGITS + "+/", _UP + _LOW + _DIGITS + "-_"]
_SETS = [frozenset(e) for e in ENCODINGS]
#: Histogram of -log10(p): this many bins a unit, this many units.
BINS_A_UNIT, UNITS = 20, 60

#: Characters by which neighbours are counted; a case counts as the other.
SYMBOLS = _LOW + _DIGITS + "+/_-"
_SYMBOL = np.full(256, -1)
for _i, _c in enumerate(SYMBOLS):
    _SYMBOL[[ord(_c), ord(_c.upper())]] = _i
#: Share of random characters that the model of text allows for, and how many of them each character's counts begin with.
RANDOM_SHARE, RANDOM_FIRST = 0.05, 64

SPANS = "array<struct<kind:int,start:int,end:int,score:double>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns."""
    found = [(0, *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return found


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by the Wilson-Hilferty normal approximation."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(1 << 16)
def _binomial_tail(n: int, k: int, rate: float) -> float:
    """P(X >= k) of X ~ Binomial(n, rate)."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate)
            + (n - i) * math.log1p(-rate) for i in range(k, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


_CLASS = bytes(0 if chr(b).islower() else 1 if chr(b).isupper() else 2 if chr(b).isdigit() else 3 for b in range(128)) + b"\x03" * 128


def _encoding(body: str) -> str | None:
    """Smallest alphabet that holds all characters."""
    seen = frozenset(body)
    return next((e for e, s in zip(ENCODINGS, _SETS, strict=True) if seen <= s), None)


def randomness(token: str) -> float:
    """Smallest p-value of the battery times the number of tests, in the inferred encoding."""
    body = token.rstrip("=")
    alphabet = _encoding(body)
    if alphabet is None or len(body) < 8:
        return 0.0
    place = {c: i for i, c in enumerate(alphabet)}
    v = np.array([place[c] for c in body], float)
    n, size = len(v), len(alphabet)
    parts = np.bincount((v * 8 // size).astype(int), minlength=8)
    share = np.bincount(np.arange(size) * 8 // size, minlength=8) / size
    chi = _chi_tail(float(((parts - n * share) ** 2 / (n * share)).sum()), 7)
    high = v >= size / 2
    n1 = int(high.sum())
    n2 = n - n1
    if n1 and n2:
        mean = 2 * n1 * n2 / n + 1
        spread = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        runs = _tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread))
    else:
        runs = 2 * 0.5**n
    d = v - v.mean()
    power = float(d @ d)
    serial = _tail(float(d[1:] @ d[:-1]) / power * math.sqrt(n)) if power else 0.0
    return min(1.0, 3 * min(chi, runs, serial))


def text_model(df: DataFrame, text_col: str) -> np.ndarray:
    """How often a character follows another one over all texts: one pass, a row a pair of ``SYMBOLS``."""
    size = len(SYMBOLS)

    def count(batches):
        total = np.zeros(size * size, np.int64)
        for b in batches:
            for text in values(b.column(0)):
                v = _SYMBOL[np.frombuffer((text or "").encode(), np.uint8)]
                known = (v[:-1] >= 0) & (v[1:] >= 0)
                total += np.bincount(v[:-1][known] * size + v[1:][known], minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["at", "n"])

    model = np.zeros(size * size)
    for at, n in df.select(F.col(text_col)).mapInArrow(count, "at int, n bigint").groupBy("at").agg(F.sum("n")).collect():
        model[at] = n
    return model.reshape(size, size)


class Unlike:
    """-log10 of a token's likelihood as text over that as random characters of its encoding."""

    def __init__(self, model: np.ndarray):
        self.model, self.tables = model, {}

    def _table(self, alphabet: str) -> np.ndarray:
        if alphabet not in self.tables:
            random = np.bincount(_SYMBOL[[ord(c) for c in alphabet]], minlength=len(SYMBOLS)) / len(alphabet)
            text = (self.model + RANDOM_FIRST * random) / (self.model.sum(axis=1, keepdims=True) + RANDOM_FIRST)
            text = (1 - RANDOM_SHARE) * text + RANDOM_SHARE * random
            self.tables[alphabet] = np.log10(np.where(random > 0, random, 1) / np.where(random > 0, text, 1))
        return self.tables[alphabet]

    def __call__(self, token: str) -> float:
        body = token.rstrip("=")
        alphabet = _encoding(body)
        if alphabet is None:
            return 0.0
        v = _SYMBOL[np.frombuffer(body.encode(), np.uint8)]
        return float(self._table(alphabet)[v[:-1], v[1:]].sum())


def token_score(token: str, text_rate: float, reject: float, unlike: Unlike | None = None) -> float:
    """-log10 of the p-value as ordinary text; 0 if the battery says that the token is not random."""
    kinds = token.encode().translate(_CLASS)
    n = len(kinds) - 1
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    score = 0.0
    if changes > text_rate * n:
        # beyond a few hundred characters the tail is smaller than the histogram shows
        p = _binomial_tail(n, changes, text_rate) if n <= 400 else math.exp(-2 * n * (changes / n - text_rate) ** 2)
        score = -math.log10(max(p, 10.0**-UNITS))
    if unlike is not None:
        score = max(score, unlike(token)) - math.log10(2)
    return min(float(UNITS), score) if score > 0 and randomness(token) >= reject else 0.0


def token_parts(token: str, min_length: int) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a token: the whole if an encoding may hold it, and its parts between '=' and
    the signs that are outside one of the encodings."""
    if token.isalnum():
        return [(0, len(token))]
    spans = [m.span() for part in PARTS for m in part.finditer(token)]
    return list(dict.fromkeys((a, b) for a, b in spans if b - a >= min_length))


def test_tokens(text: str, tokens: re.Pattern, min_length: int, text_rate: float, reject: float,
                unlike: Unlike | None = None) -> tuple[list[tuple[int, int, int, float]], int]:
    """(kind, start, end, score) of the tokens or parts that may be secrets, of parts that overlap the best, and the
    number of tests."""
    found, tested = [], 0
    for m in tokens.finditer(text):
        token, scored = m.group(), []
        for a, b in token_parts(token, min_length):
            tested += 1
            part = token[a:b]
            if unlike is not None or not (part[1:].islower() and part.isalpha()):
                s = token_score(part, text_rate, reject, unlike)
                if s > 0:
                    scored.append((-s, a - b, a, b))
        taken: list[tuple[int, int]] = []
        for s, _, a, b in sorted(scored):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                found.append((3, m.start() + a, m.start() + b, -s))
    return sorted(found), tested


def scanner(text: Column, *, min_length: int = 16, text_rate: float = 0.1, reject: float = 0.001, model: np.ndarray | None = None) -> Column:
    """Column: all spans of a text, with the ``text_model`` of the corpus.  Tested tokens have kind ``random`` and their score; base spans have score null.
    The last element, kind -1, has the number of tested tokens as its end."""
    tokens = re.compile(TOKEN + "{%d,}" % min_length)
    unlike = None if model is None else Unlike(model)

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        size, kind, start, end, score = [0], [], [], [], []
        for text in values(texts):
            found, tested = test_tokens(text or "", tokens, min_length, text_rate, reject, unlike)
            for k, a, b, s in [*((*b, None) for b in base_spans(text or "")), *found]:
                kind.append(k), start.append(a), end.append(b), score.append(s)
            kind.append(-1), start.append(0), end.append(tested), score.append(None)
            size.append(len(kind))
        fields = [pa.array(kind, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score, pa.float64())]
        return pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.StructArray.from_arrays(
            fields, names=["kind", "start", "end", "score"]))

    return scan.asNondeterministic()(text)


def threshold(found: DataFrame, spans_col: str, fdr: float = 0.01) -> float:
    """Smallest score that the Benjamini-Hochberg rule reports, over all rows; infinite if none.
    Scores are rounded down to a bin, so the rule is never relaxed."""
    one = found.select(F.explode(spans_col).alias("s")).where("s.kind in (-1, 3)")
    binned = F.when(F.col("s.kind") == 3, F.floor(F.col("s.score") * BINS_A_UNIT).cast("int")).otherwise(-1)
    hist = dict(one.groupBy(binned.alias("b")).agg(
        F.sum(F.when(F.col("s.kind") == 3, F.lit(1)).otherwise(F.col("s.end")).cast("long"))).collect())
    tests = hist.pop(-1, 0)
    above, best = 0, math.inf
    for b in sorted(hist, reverse=True):
        above += hist[b]
        if 10.0 ** (-b / BINS_A_UNIT) <= fdr * above / tests:
            best = b / BINS_A_UNIT
    return best


def reported(spans: Column, least: float) -> Column:
    """Base spans and the random tokens at or above the threshold that no base span holds, by start then kind."""
    base = F.filter(spans, lambda s: s["kind"].between(0, 2))
    held = lambda s: F.exists(base, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    kept = F.filter(spans, lambda s: s["kind"].between(0, 2) | ((s["kind"] == 3) & (s["score"] >= F.lit(least)) & ~held(s)))
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def joined(spans: Column) -> Column:
    """kind:start:end of ordered spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[REDACTED]",
           fdr: float = 0.01, **battery) -> DataFrame:
    """``df`` with every reported span of its texts replaced; rows without one are unchanged.

    Three passes over the texts: the first counts neighbours, the second finds the threshold, the third rewrites.
    """
    ship(df)
    unlike = Unlike(text_model(df, text_col))
    least = threshold(df.select(scanner(F.col(text_col), model=unlike.model, **battery).alias("s")), "s", fdr)
    new = "text_of_secret_stage"
    rate, reject, shortest = battery.get("text_rate", 0.1), battery.get("reject", 0.001), battery.get("min_length", 16)
    tokens = re.compile(TOKEN + "{%d,}" % shortest)

    def rewritten(text: str) -> str:
        random = [(a, b) for _, a, b, s in test_tokens(text, tokens, shortest, rate, reject, unlike)[0] if s >= least]
        parts, at = [], 0
        for a, b in sorted([*((a, b) for _, a, b in base_spans(text)), *random]):
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    @F.arrow_udf("string")
    def rewrite(texts: pa.Array) -> pa.Array:
        return pa.array((t and rewritten(t) for t in values(texts)), pa.string())

    marked = df.withColumn(new, rewrite.asNondeterministic()(F.col(text_col)))
    columns = [F.col(new).alias(c) if c == text_col else
               F.when(F.col(new).eqNullSafe(F.col(text_col)), F.col(c)).otherwise(F.length(new)).cast(df.schema[c].dataType).alias(c)
               if c == length_col else F.col(c) for c in df.columns]
    return marked.select(*columns)
