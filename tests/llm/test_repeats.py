"""Hashes, row names and buckets of the two operators that find repeated passages."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import _repeats, _work, substring_dedup, suffix_dedup


def thue_morse(doublings):
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def plain_words(rows, window):
    """Removed word positions by the definition; ids of None come last."""
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i: (i is None, i if i is not None else 0)
    for i, w in texts:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, key(i)), key(i))
    out = []
    for i, w in texts:
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < key(i):
                gone.update(range(p, p + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


def plain_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append((i, len(t), int(gone.sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def op10(df, **how):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df, **how).collect())


def op4(df, **how):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup(df, **how).collect())


def test_products_modulo_the_prime():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, _work.PRIME, 70_000, dtype=np.uint64) for _ in range(2))
    a[:4], b[:4] = [0, 1, _work.PRIME - 1, _work.PRIME - 1], [5, _work.PRIME - 1, _work.PRIME - 1, 1]
    assert _work.times_modulo(a, b).tolist() == [x * y % _work.PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]


@pytest.mark.parametrize("doublings", [8, 10, 11])
def test_thue_morse_strings_have_different_hashes(doublings):
    """Any odd base modulo 2**64 gives these strings one hash from 2**11 letters on."""
    for seed in (11, 12, 31, 32):
        roller = _work.Roller(seed)
        a, b = (roller.prefix(roller.table[np.frombuffer(t.encode(), np.uint8)]) for t in thue_morse(doublings))
        x, y = roller.windows(a, len(a) - 1), roller.windows(b, len(b) - 1)
        assert x != y and bin(int(x[0] ^ y[0])).count("1") > 8


def test_words_that_only_look_alike_stay(spark):
    """op10 once removed all of the second document, whose long word differs in every letter."""
    one, other = thue_morse(11)
    rest = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, f"{other} {rest}")]
    got = op10(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == plain_words(rows, 50)
    assert sorted(n for _, _, n, _ in got) == [0, 0, 50]


def test_bytes_that_only_look_alike_stay(spark):
    one, other = thue_morse(8)
    rows = [(1, "x" + one + "y"), (2, "z" + other + "w"), (3, "q" + other[:220])]
    assert op4(spark.createDataFrame(rows, "doc_id long, text string")) == plain_bytes(rows, 200)


def test_ids_of_any_type_are_ordered(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [("document-with-a-long-name-2", shared + " end"), ("document-with-a-long-name-10", shared), ("document-with-a-long-name-10", shared), ("a", "b " + shared),
            (None, shared), ("z", "nothing here")]
    got = op10(spark.createDataFrame(rows, "doc_id string, text string"))
    assert {(i, n) for i, _, n, _ in got} == {("document-with-a-long-name-2", 60), ("document-with-a-long-name-10", 60), ("a", 0), (None, 60), ("z", 0)}


def test_rows_whose_names_collide_keep_their_own_positions(spark, monkeypatch):
    """With one 64-bit name for all rows, the tag above the positions tells them apart."""
    from pyspark.sql import functions as F

    for module in (substring_dedup, suffix_dedup):
        monkeypatch.setattr(module, "row_ref", lambda i, t: F.lit(7).cast("long"))
    words = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, words[0]), (2, "x " + words[0]), (3, words[1] + " one"), (4, "y z " + words[1]), (5, words[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert op10(df) == plain_words(rows, 50)
    assert op4(df) == plain_bytes(rows, 200)


@pytest.mark.parametrize("hot", [1, 3, 20_000])
def test_neighbours_across_batches_and_partitions(spark, hot):
    """Repeats with different surroundings; batches of three rows cut runs of one token, which are carried on."""
    rng = np.random.default_rng(3)
    letters = lambda n: "".join(rng.choice(list("abcd "), n))
    shared = [letters(230) for _ in range(4)]
    rows = [(i, letters(30) + shared[i % 4][: 201 + i] + letters(20) + shared[(i + 1) % 4][i % 7 :] + letters(9)) for i in range(24)]
    rows += [(100, "ab" * 300), (101, "ab" * 101 + "c" + "ab" * 99), (102, None), (None, rows[0][1])]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for parts in (1, 5):
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
            assert op4(df, hot=hot) == plain_bytes(rows, 200)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_runs_are_whole_whatever_the_batches():
    import pyarrow as pa

    keys = sorted([1, 1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 5, 5])
    for size in (1, 2, 3, 5, 20):
        cut = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(range(i, min(i + size, len(keys))))], ["k", "v"]) for i in range(0, len(keys), size)]
        seen = list(_repeats.grouped(cut))
        assert [v for _, c in seen for v in c.tolist()] == list(range(len(keys)))
        where = defaultdict(set)
        for n, (k, _) in enumerate(seen):
            for x in k.tolist():
                where[x].add(n)
        assert all(len(x) == 1 for x in where.values())


def test_multikey_sort_of_strings_is_exact():
    length = 21
    texts = [b"0123456789abcdefghijklmn", b"x0123456789abcdefghijk!", b"0123456789abcdefghijk"]
    off = [5, 6, 5]
    place = np.array([s << 16 | (len(t) - length + 1) << 8 | o for s, (t, o) in enumerate(zip(texts, off, strict=True))], np.int64)
    ref, found = suffix_dedup.sort_strings(np.zeros(3, np.int64), np.arange(3), place, texts, length)
    assert sorted(zip(ref.tolist(), (found >> 16).tolist(), (found >> 8 & 255).tolist(), strict=True)) == [(0, 0, 1), (1, 2, 1), (2, 2, 1)]
