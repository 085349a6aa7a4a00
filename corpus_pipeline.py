"""A corpus pipeline: each stage applies one operator to all that the stage before it kept.

1. language ID: documents without a determined language, or without one that
   makes up half of the text, go;
2. SimHash near-dedup: one document of each group stays (the smallest doc_id);
3. benchmark decontamination: documents that hold a test item go;
4. secret scans: reported spans are replaced; no document goes;
5. best-fit packing: a row per packed piece.

Stages 1 to 4 return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import best_fit_packing, decontaminate, language_id, queries, secret_scan, simhash
from tessera.llm._work import written


def language(spark, docs, sf_dir):
    model = queries.language_model(docs)
    mark = "language_of_language_stage"
    marked = docs.withColumn(mark, language_id.predicted(F.col("text"), model))
    return marked.where((F.col(mark + ".lang") != language_id.UNDETERMINED) & (F.col(mark + ".score") >= 0.5)).drop(mark)


def near_dedup(spark, docs, sf_dir):
    return simhash.keep_one(docs, shingle=4, radius=4)


def decontamination(spark, docs, sf_dir):
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def secrets(spark, docs, sf_dir):
    return secret_scan.redact(docs)


def packing(spark, docs, sf_dir):
    return best_fit_packing.pack(docs, queries.tokenizer())


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination),
          ("secret_scan", secrets), ("best_fit_packing", packing)]

#: No stage can be expressed in SQL; tests/llm checks each against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on the documents of ``sf_dir``, each written before the next one reads it."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
