"""The operators on the given tables, and SQL for what SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    best_fit_packing,
    decontaminate,
    language_id,
    lattice_score,
    license_scan,
    metric_search,
    ring_sharding,
    secret_scan,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_alignment,
    whitening,
)
from ._work import ship, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; TOKENIZER_DIR overrides the installed package's."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_best_fit_packing(spark, sf_dir):
    return best_fit_packing.pack(table(spark, sf_dir, "documents"), tokenizer())


@query
def op2_metric_search(spark, sf_dir):
    return metric_search.top_k(table(spark, sf_dir, "embeddings"), every_row=True)


ORACLE["op2_metric_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op3_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ship(docs)
    model = secret_scan.text_model(docs, "text")
    found = written(docs.select("doc_id", secret_scan.scanner(F.col("text"), model=model).alias("s")), "secrets")
    least = secret_scan.threshold(found, "s")
    count = lambda k: F.size(F.filter("s", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.withColumn("spans", secret_scan.reported(F.col("s"), least)).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"))


@query
def op4_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


@query
def op5_ring_sharding(spark, sf_dir):
    placed = ring_sharding.assign(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@query
def op6_license_scan(spark, sf_dir):
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    return license_scan.scan(table(spark, sf_dir, "documents"), path)


@query
def op7_simhash(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op8_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def held_out(doc_id):
    """True for a quarter of the ids; a null id is not held out, and not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_model(docs: DataFrame, **params) -> language_id.Model:
    known = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    return language_id.train(docs.where(known).select("text", "lang"), **params)


@query
def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_model(docs)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_id.predicted(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@query
def op10_substring_dedup(spark, sf_dir):
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def left_out(doc_id):
    """True for a seventh of the ids; a null id is not left out, and not learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


@query
def op11_lattice_score(spark, sf_dir):
    doc_id = F.col("doc_id")
    found = lattice_score.score(table(spark, sf_dir, "documents"), lattice_score.read_ranks(tokenizer("byte_bpe_multi_50k.tiktoken")),
                                doc_id.isNotNull() & ~left_out(doc_id))
    return found.withColumn("held_out", left_out(doc_id))


@query
def op12_token_alignment(spark, sf_dir):
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query
def op13_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
