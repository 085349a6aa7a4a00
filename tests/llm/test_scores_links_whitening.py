"""Lattice scores, token alignment and whitening against plain versions, on real rows plus the hard ones."""

import hashlib
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF_SMALL
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import lattice_score, queries, token_alignment, whitening

EXTRA = "row long, id string, learn int, words string, times long, pairs long, n long, x double, index long, v string, part int"


def wide(rows):
    return [(*r, *[None] * 11) for r in rows]


@pytest.fixture(scope="module")
def rows(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).collect()]
    hard = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "é"), (1004, "ABC abc " * 10_000), (1005, "x" * 9000), (1005, "x" * 9000), (None, real[3][1]),
            (None, "only here"), (1006, "  two  spaces and more   \x1c \x85 a"), (1007, "a <|endoftext|> b</s> <s> <0x41> ½ ﬁ 𝔘 \x00"),
            (1008, "a▁b ▁ c"), (1009, "don't we'll I'M\r\n\r\n end. 12345 67"), (1010, " lead"), (1011, "ſ İ ẞ ç 中文字 กขค")]
    return real + hard


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(wide(rows), f"doc_id long, text string, {EXTRA}").repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


# --- lattice scores

PIECES = [b"th", b" th", b"the", b" the", b"ab", b"abc", b" a", b"bc", b"\xc3\xa9", b" abc", b"aaaaaaaaaaaaaaaa", b"aaaaaaaaaaaaaaaaa"] + [bytes([b]) for b in range(256)]


def splits(word, pieces):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            for rest in splits(word[k:], pieces):
                yield (word[:k], *rest)


def plain_model(counts, ends, pieces, rounds):
    """Expectation-maximisation by listing every segmentation."""
    usable = [p for p in pieces if len(p) <= lattice_score.LONGEST]
    zipf = {p: 1 / (i + 2) for i, p in enumerate(pieces) if len(p) <= lattice_score.LONGEST}
    scale = len(usable) / sum(zipf.values())
    prior = {p: z * scale for p, z in zipf.items()}

    def normal(extra, ends):
        total = sum(prior.values()) + sum(extra.values()) + 1 + ends
        return {p: (prior[p] + extra.get(p, 0)) / total for p in usable}, (1 + ends) / total

    prob, end = normal({}, 0)
    for _ in range(rounds):
        extra = defaultdict(float)
        for w, c in counts.items():
            each = [(math.prod(prob[p] for p in s), s) for s in splits(b" " + w, prob)]
            whole = sum(x for x, _ in each)
            for x, s in each:
                for p in s:
                    extra[p] += c * x / whole
        prob, end = normal(extra, ends)
    return prob, end


def plain_word(word, prob):
    return sum(math.prod(prob[p] for p in s) for s in splits(b" " + word, prob))


def test_lattice_is_the_sum_over_all_segmentations():
    model = lattice_score.Model(PIECES)
    words = [b"the", b"thethe", b"abcabc", "é".encode(), b"", b"zz", b"a", b"abthe"]
    prob = {p: math.exp(model.logp[i]) for i, p in enumerate(PIECES) if len(p) <= lattice_score.LONGEST}
    got = model.word_scores(pa.array(words, pa.binary()))
    assert np.allclose(got, [math.log(plain_word(w, prob)) for w in words], rtol=1e-12)


def test_lattice_blocks_join_up():
    """A long word handled in blocks of few starts has the same sums and expected counts as in one block."""
    model = lattice_score.Model(PIECES)
    text = np.frombuffer(b" " + b"abcthe" * 40 + b"a" * 50, np.uint8)[None].copy()
    logp = model.of_pieces()
    for step in (1, 7, 16, 64):
        assert np.allclose(model.lattice.forward(text, logp, step), model.lattice.forward(text, logp, 10_000))
        some, whole = np.zeros(len(PIECES)), np.zeros(len(PIECES))
        model.lattice.expected(text, np.array([3.0]), logp, step, some)
        model.lattice.expected(text, np.array([3.0]), logp, 10_000, whole)
        assert np.allclose(some, whole)


def test_parts_of_a_long_text_hold_its_words():
    text = " Aa  b\tCC\n" * 50 + "long" * 40
    parts = list(lattice_score.parts_of(text, 64))
    assert len(parts) > 5
    assert [w for p in parts for w in p.split()] == text.lower().encode().split()
    assert list(lattice_score.parts_of(None)) == [b""]


@pytest.mark.parametrize("sent", [((4, 0, 64), (1, 64, 4096)), lattice_score.FREQUENT])
def test_lattice_scores_of_documents(spark, monkeypatch, sent):
    monkeypatch.setattr(lattice_score, "FREQUENT", sent)
    rows = [(1, "The abc the"), (2, None), (3, ""), (4, "abc  ABC é\x0bthe"), (5, "thab zz"), (6, "never seen"), (6, "never seen"), (None, "the null"),
            (7, "a" * 20), (8, "the " * 5), (12, "É é"), (15, "abthe thab")]
    learnt = {i for i, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2}
    assert len(learnt) < len({i for i, _ in rows if i is not None})
    words = {i: (t or "").encode().lower().split() for i, t in rows}
    counts = Counter(w for i, t in rows if i in learnt for w in (t or "").encode().lower().split())
    ends = sum(i in learnt for i, _ in rows)
    prob, end = plain_model(counts, ends, PIECES, 2)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    df = spark.createDataFrame(wide(rows), f"doc_id long, text string, {EXTRA}").repartition(3)
    got = lattice_score.score(df, PIECES, F.col("doc_id").isNotNull() & ~queries.left_out(F.col("doc_id"))).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        mine = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine) + 1, sum(counts[w] > 0 for w in mine) + 1, n)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine) + math.log10((ends + 1) / (n + v + 1))
        assert r.base_score == pytest.approx(base, rel=1e-12)
        assert r.score == pytest.approx(sum(math.log10(plain_word(w, prob)) for w in mine) + math.log10(end), rel=1e-9)


def test_lattice_scores_on_hard_rows(spark, docs, rows, nothing):
    found = lattice_score.score(docs, lattice_score.read_ranks(queries.tokenizer("byte_bpe_multi_50k.tiktoken")), F.col("doc_id") % 3 != 0, rounds=1).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == Counter((i, len((t or "").encode().split()) + 1) for i, t in rows)
    assert all(math.isfinite(r.score) and r.score < 0 and math.isfinite(r.base_score) for r in found)
    assert lattice_score.score(nothing, PIECES, F.lit(True)).count() == 0
    unlearnt = lattice_score.score(docs.where("doc_id = 1003"), PIECES, F.lit(None).cast("boolean")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in unlearnt] == [(2, 0, 0, 0.0)]


def test_lattice_needs_every_byte():
    with pytest.raises(ValueError, match="byte 255"):
        lattice_score.Lattice([bytes([b]) for b in range(255)])


def test_more_rounds_raise_the_likelihood():
    words = [w.encode() for w in "the cat that sat then thence other bathe".split()]
    model, seen = lattice_score.Model(PIECES), []
    for _ in range(4):
        seen.append(model.word_scores(pa.array(words)).sum())
        out = np.zeros(len(PIECES))
        for at, text, step in lattice_score.equally_long(pa.array(words)):
            model.lattice.expected(text, np.ones(len(at)) * 50, model.of_pieces(), step, out)
        model.set(out, 400)
    assert seen == sorted(seen)


# --- token alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(rows):
    """Whole texts, never cut; tokens met one by one."""
    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    visible = {c: x for x, c in token_alignment_bytes().items()}
    out, counts = [], Counter()
    for doc_id, text in rows:
        whole = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(visible[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            m = re.fullmatch(r"<0x(..)>", b.id_to_piece(i))
            bytes_b.append(bytes.fromhex(m[1]) if m else b.id_to_piece(i).replace("▁", " ").encode())
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append((doc_id, 0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(x, y) for x, e in zip(ids_a, ends_a, strict=True) for y, f in ([(ids_b[k], e) for k in positions(ends_b, e)])]
        groups, i, j = [], 0, 0
        while i < len(ids_a):
            k, m = i, j
            while ends_a[k] != ends_b[m]:
                if ends_a[k] < ends_b[m]:
                    k += 1
                else:
                    m += 1
            groups.append((ids_a[i : k + 1], ids_b[j : m + 1]))
            i, j = k + 1, m + 1
        counts.update(links)
        out.append((doc_id, len(ids_a), len(ids_b), groups, links))
    best = defaultdict(int)
    for (_, y), c in counts.items():
        best[y] = max(best[y], c)
    for doc_id, n_a, n_b, groups, links in out:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
               hashlib.sha256(text.encode()).hexdigest() if n_a else "")


def positions(ends, e):
    k = bisect_left(ends, e)
    return [k] if k < len(ends) and ends[k] == e else []


@cache
def token_alignment_bytes():
    """Character of each byte, from the rule of byte-level vocabularies."""
    own = set(range(ord("!"), ord("~") + 1)) | set(range(ord("¡"), ord("¬") + 1)) | set(range(ord("®"), ord("ÿ") + 1))
    out, more = {}, 256
    for b in range(256):
        out[b] = chr(b) if b in own else chr(more)
        more += b not in own
    return out


@pytest.mark.parametrize("frequent", [0, 5, 1 << 18])
def test_alignment_of_documents(docs, rows, frequent):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = token_alignment.align_tokens(docs, A_PATH, B_PATH, frequent=frequent)
    assert got.columns == names
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_alignment(rows))


def test_alignment_in_pieces():
    """Small pieces, whose units are encoded apart, give what whole texts give."""
    enc = token_alignment.Encoders(A_PATH, B_PATH)
    texts = ["one two  three\n four five " * 40, "", None, "x", "a▁b", "it's we'll   x  y 'll z", "ends in space \t", "\n", "  ", "ends in space \t"]
    same = lambda rows: [(*r[:5], dict(zip(r[5].tolist(), r[6].tolist(), strict=True))) for r in rows]
    large = same(token_alignment.all_aligned(enc, texts))
    for size in (1, 30, 200):
        assert same(token_alignment.all_aligned(enc, texts, size)) == large
    assert large[1][:5] == large[2][:5] == large[4][:5] == (0, 0, 0, 0, "")
    parts = [u for units in token_alignment.pieces_of(texts[0], 50) for u in units]
    assert parts == token_alignment.CUT.split(texts[0]) and " ".join(parts) == texts[0]


def test_units_that_cannot_be_spelled_are_found(monkeypatch):
    """Where B spells some unit otherwise, the other texts of the batch keep their tokens."""
    enc = token_alignment.Encoders(A_PATH, B_PATH)
    real = enc.b.encode

    class Other:
        def encode(self, texts, **how):
            return real([t.replace("bad", "bud") for t in texts], **how)

    enc.b = Other()
    found = list(token_alignment.all_aligned(enc, ["good words", "a bad word", "more good words"]))
    assert [f[0] > 0 for f in found] == [True, False, True]


def test_a_vocabulary_that_crosses_cuts_is_an_error():
    with pytest.raises(ValueError, match="holds a place where texts are cut"):
        token_alignment.Tokens([b"a b"])
    token_alignment.Tokens([b" a", b"  ", " \u00a0 \u00a0".encode()])


def test_alignment_of_nothing(nothing):
    assert token_alignment.align_tokens(nothing, A_PATH, B_PATH).count() == 0


# --- whitening

def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1]), (None, rows[8][1]), (None, [0.25] * 6)]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf"), *[0.0] * 5]), (2005, [1.0, 2.0])]
    schema = f"vec_id long, embedding array<float>, {EXTRA}"
    return rows, spark.createDataFrame(wide(rows + bad), schema).repartition(4)


def test_whitening_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 32)  # ten blocks
    rows, df = vectors(spark)
    x = {i: tuple(int(math.floor(256 * float(np.float32(c)))) for c in v) for i, v in rows}
    fit = np.array(sorted({*x.values()}), np.int64)
    n, total = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T.astype(float), bias=True)
    values, w = np.linalg.eigh(cov)
    values, w = values[::-1][:4], w[:, ::-1][:, :4]
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k) for i, _ in rows for k in range(1, 5))
    sign = {}
    null_ids = []
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        if r.vec_id is None:
            null_ids.append(r)
            continue
        v = np.array(x[r.vec_id])
        assert r.deviation == sum(int(d) ** 2 for d in n * v - total)
        want = (v - total / n) @ w[:, r.component - 1] / math.sqrt(values[r.component - 1])
        if abs(want) > 1e-6:
            assert sign.setdefault(r.component, math.copysign(1, want * r.whitened)) == math.copysign(1, want * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(want), abs=1e-9)
    assert len(null_ids) == 8


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], schema)).collect()
    assert {r.component for r in line} == {1} and len(line) == 5
    assert line[0].explained == pytest.approx(1)


def test_deviation_beyond_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e16, 0.0]), (2, [-1e16, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(df).collect()


def test_queries_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name in ("op11_lattice_score", "op12_token_alignment"):
        assert queries.QUERIES[name](spark, SF_SMALL).count() == docs.count()
    vecs = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").where("embedding is not null")
    assert queries.QUERIES["op13_whitening"](spark, SF_SMALL).count() == 4 * vecs.count()
