"""Operators that no SQL expresses against plain loops over the definitions, on small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, license_scan, queries, ring_sharding, secret_scan

DOCS = "doc_id long, text string"


# --- op3

def test_share_of_planted_keys_that_is_found(spark, tmp_path):
    """Keys of several encodings and lengths in running text: figures of README."""
    rng = np.random.default_rng(9)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").where("text is not null").limit(150).collect()
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {"mixed": lower + upper + digits, "base64": lower + upper + digits + "+/", "base32": upper + "234567", "lower and digits": lower + digits}
    rows, planted = [], {}
    for k, r in enumerate(docs):
        words = r.text.split(" ")
        kind = list(kinds)[k % 4]
        size = (24, 32, 40)[k % 3]
        key = "".join(rng.choice(list(kinds[kind]), size))
        words.insert(len(words) // 2, key)
        text = " ".join(words)
        rows.append((r.doc_id, text))
        planted[r.doc_id] = (kind, size, text.index(key), text.index(key) + size)
    df = spark.createDataFrame(rows, DOCS)
    model = secret_scan.text_model(df, "text")
    found = queries.written(df.select("doc_id", secret_scan.scanner(F.col("text"), model=model).alias("s")), "planted")
    least = secret_scan.threshold(found, "s")
    got = {r.doc_id: r.spans for r in found.select("doc_id", secret_scan.joined(secret_scan.reported(F.col("s"), least)).alias("spans")).collect()}
    hit, other = defaultdict(list), 0
    for i, (kind, size, a, b) in planted.items():
        spans = {(int(x.split(":")[1]), int(x.split(":")[2])) for x in filter(None, got[i].split(",")) if x.startswith("random")}
        hit[kind, size].append((a, b) in spans)
        other += len(spans - {(a, b)})
    recall = {k: sum(v) / len(v) for k, v in hit.items()}
    print(sorted(recall.items()), "others", other)
    assert sum(map(sum, hit.values())) / len(planted) > 0.9
    assert other <= 0.02 * len(planted)


# --- op5

def plain_ring(cells, nodes, room):
    """Each row by itself: clockwise from its cell to the first node whose shard has room."""
    used, placed = Counter(), []
    for cell in cells:
        first = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
        for step in range(len(nodes)):
            shard = nodes[(first + step) % len(nodes)][1]
            if used[shard] < room[shard]:
                placed.append((cell, shard, used[shard]))
                used[shard] += 1
                break
    return placed


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_ring_places_every_row_where_a_walk_by_hand_does(shards):
    rng = np.random.default_rng(shards)
    cells = sorted(rng.integers(0, 1 << 8, 600).tolist() + [77] * 200)
    nodes = ring_sharding.ring(shards, 16, 8)
    room = [len(cells) // shards + (s < len(cells) % shards) for s in range(shards)]
    counts = dict(Counter(cells))
    got = [(cell, shard, base + k) for cell, first, until, shard, base in ring_sharding.walk(counts, nodes, room) for k in range(until - first)]
    assert got == plain_ring(cells, nodes, room)


def test_rows_that_move_when_shards_or_rows_are_added():
    rng = np.random.default_rng(2)
    counts = Counter(rng.integers(0, 1 << 14, 200_000).tolist())

    def placed(counts, shards):
        total = sum(counts.values())
        runs = ring_sharding.walk(counts, ring_sharding.ring(shards, 128, 14), [total // shards + (s < total % shards) for s in range(shards)])
        return {(cell, k): shard for cell, first, until, shard, _ in runs for k in range(first, until)}

    was = placed(counts, 24)
    grown = placed(counts, 25)
    assert 0.04 <= sum(grown[k] != s for k, s in was.items()) / len(was) < 0.08  # a 25th must move
    more = placed(counts + Counter(rng.integers(0, 1 << 14, 2_000).tolist()), 24)
    assert sum(more[k] != s for k, s in was.items()) / len(was) < 0.02


# --- op6

def plain_cosines(docs, templates, least):
    """Best cosine of each text's lines and of its windows as long as a template, or a quarter longer."""
    known = {p for _, t in templates for p in license_scan.pairs(t)}
    holders = Counter(p for _, t in docs for p in set(license_scan.pairs((t or "").replace("\n", " "))) & known)
    idf = lambda p: math.log((len(docs) + 1) / ((holders[p] if p in known else 0) + 1)) + 1
    length = lambda v: math.sqrt(sum((n * idf(p)) ** 2 for p, n in v.items()))
    out = {}
    for d, text in docs:
        stretches = [(None, license_scan.pairs(line)) for line in (text or "").split("\n")]
        whole = license_scan.pairs((text or "").replace("\n", " "))
        for k, (_, t) in enumerate(templates):
            own = license_scan.pairs(t)
            for n in (len(own), len(own) + len(own) // 4):
                stretches += [(k, whole[a : a + n]) for a, p in enumerate(whole) if p in own]
        best = 0.0
        for only, stretch in stretches:
            v = Counter(stretch)
            for k, (_, t) in enumerate(templates):
                w = Counter(license_scan.pairs(t))
                if v and only in (None, k):
                    best = max(best, sum(v[p] * w[p] * idf(p) ** 2 for p in v) / (length(v) * length(w)))
        out[d] = best if best >= least else None
    return out


def test_license_scores_are_cosines(spark):
    templates = [("A", "alpha beta gamma delta epsilon zeta eta"), ("B", "alpha beta gamma theta iota kappa"), ("C", "one two three one two three four")]
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa one two three four other words here".split()
    rng = np.random.default_rng(6)
    docs = [(0, "alpha beta gamma delta epsilon zeta eta"), (1, "see: alpha beta gamma\ntheta iota kappa and more"), (2, None), (3, ""), (4, "one two three one two three")]
    for k in range(5, 60):
        t = templates[k % 3][1].split()
        kept = [w for w in t if rng.random() > 0.2]
        around = [" ".join(rng.choice(words, 4)) for _ in range(2)]
        docs.append((k, f"{around[0]}{' ' if k % 2 else chr(10)}{' '.join(kept)}{chr(10) if k % 4 else ' '}{around[1]}"))
    got = license_scan.scan(spark.createDataFrame(docs, DOCS).repartition(3), F.lit(None).cast("string"), templates=templates, texts=[], least=0.6).collect()
    want = plain_cosines(docs, templates, 0.6)
    assert sum(v is not None for v in want.values()) > 20
    for r in got:
        assert (r.score is None) == (want[r.doc_id] is None), (r, want[r.doc_id])
        assert r.score is None or r.score == pytest.approx(want[r.doc_id], abs=1e-6)


# --- op8

def plain_leaks(docs, items, least=0.6, question=0.5, answer=0.5):
    """Every passage of every text against every item by whole sums, no index and no bound."""
    words = {i: decontaminate.words_of(t) for i, t in items}
    n, mean = len(items), sum(map(len, words.values())) / len(items)
    holders = Counter(w for x in words.values() for w in set(x))
    width = max(64, 2 * max(map(len, words.values())))
    stride = width // 2
    out = set()
    for d, text in docs:
        own = decontaminate.words_of(text)
        for start in range(0, max(1, len(own) - stride), stride) if own else ():
            inside = own[start : start + width]
            for i, _ in items:
                count = Counter(words[i])
                norm = 1.2 * (1 - 0.75 + 0.75 * len(words[i]) / mean)
                impact = {w: math.log1p((n - holders[w] + 0.5) / (holders[w] + 0.5)) * c * 2.2 / (c + norm) for w, c in count.items()}
                if not impact or sum(x for w, x in impact.items() if w in set(inside)) / sum(impact.values()) < least:
                    continue
                shares = []
                for side in decontaminate.question_answer(dict(items)[i]):
                    k = min(3, len(side))
                    grams = {tuple(side[a : a + k]) for a in range(len(side) - k + 1)} if side else set()
                    seen = {tuple(inside[a : a + k]) for a in range(len(inside) - k + 1)}
                    shares.append(len(grams & seen) / len(grams) if grams else 1.0)
                if shares[0] >= question and shares[1] >= answer:
                    out.add((d, i))
    return out


def test_contamination_is_what_all_passages_against_all_items_give(spark):
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").where("text is not null")
    items = [tuple(r) for r in bench.orderBy("item_id").limit(25).collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").orderBy("doc_id").limit(60).collect()]
    rng = np.random.default_rng(4)
    for k, (_, text) in enumerate(items):
        words = text.split()
        drop = rng.random(len(words)) < (0, 0.1, 0.3, 0.6)[k % 4]  # from whole items to ones that are hardly there
        docs.append((5000 + k, f"{docs[k][1][:700]} {' '.join(w for w, d in zip(words, drop, strict=True) if not d)} {docs[k + 1][1][:300]}"))
    want = plain_leaks(docs, items)
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert 8 < len(want) < 60


# --- op9

def plain_trigrams(text, bits):
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in f" {text.lower()} ".encode()]
    found = Counter()
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        if not (a == b == 32 or b == c == 32):
            found[(a << 16 | b << 8 | c) * 2654435761 % 2**32 >> (32 - bits)] += 1
    return found


def test_language_mixtures_are_those_of_a_plain_loop(spark):
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text", "lang").where("lang is not null and text is not null and length(text) < 4000")
    rows = [tuple(r) for r in table.limit(80).collect()]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"), bits=10)
    counts = defaultdict(Counter)
    for text, lang in rows:
        counts[lang] += plain_trigrams(text, 10)
    size = {x: sum(c.values()) + 0.5 * 1024 for x, c in counts.items()}
    assert model.languages == sorted(counts)
    for text in [rows[0][0], rows[5][0][:300] + " " + rows[9][0][:300], "ein the una"]:
        grams = plain_trigrams(text, 10)
        share = dict.fromkeys(counts, 1 / len(counts))
        for _ in range(40):
            new = dict.fromkeys(counts, 0.0)
            for g, n in grams.items():
                likely = {x: share[x] * (counts[x][g] + 0.5) / size[x] for x in counts}
                for x in counts:
                    new[x] += n * likely[x] / sum(likely.values())
            new = {x: v / sum(grams.values()) for x, v in new.items()}
            done = max(abs(new[x] - share[x]) for x in counts) < 1e-3
            share = new
            if done:
                break
        hist = language_id.histogram(text, 10)
        assert {int(k): int(hist[k]) for k in np.flatnonzero(hist)} == dict(grams)
        at = np.flatnonzero(hist)
        mine, _ = language_id._em(model.probs[at], hist[at].astype(float), float(hist.sum()), np.full(len(counts), 1 / len(counts)))
        assert mine == pytest.approx([share[x] for x in model.languages], abs=1e-9)
        assert max(language_id.mixture(text, model), key=language_id.mixture(text, model).get) == max(share, key=share.get)


def test_the_language_stage_drops_what_is_undetermined_or_mixed(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = queries.language_model(docs)
    two = {r[0]: r[1] for r in docs.where("lang is not null and length(text) > 1500").groupBy("lang").agg(F.first("text")).collect()}
    mixed = " ".join(t[:700] for t in two.values())
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 ½ !"), (-4, mixed), (-5, next(iter(two.values())))], DOCS)
    every = docs.unionByName(extra, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, every, None).select("doc_id").collect()}
    for r in extra.union(docs.select("doc_id", "text").limit(60)).collect():
        shares = language_id.mixture(r.text, model)
        assert (r.doc_id in kept) == (max(shares.values(), default=0) >= 0.5), r.doc_id
    assert {-1, -2, -3, -4}.isdisjoint(kept) and -5 in kept
    assert re.match("und", language_id.UNDETERMINED)
