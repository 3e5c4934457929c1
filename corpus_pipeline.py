"""The corpus pipeline: toxicity, near duplicates, benchmark items, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but
the last return the columns of ``documents``; ``run`` writes each result as Parquet in the shared
folder and hands the reread table to the next stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import containment, near_dups, packing, secrets, toxicity
from keelson.llm.common import table
from keelson.plans.durable import written

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the threshold, by a classifier fitted on the labels of ``docs``; a NULL text is scored as an empty one."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.below(docs.select(*DOCUMENT), model, toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of every group of near copies, once.

    Groups are the components of SimHash fingerprints of three-word shingles that differ in at
    most three bits.
    """
    groups = near_dups.near_groups(docs)
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "of")).alias("row"))
    kept = first.select(F.col("row.id").alias("kept_id"), F.col("row.of").alias("kept_of"))
    rows = docs.select(*DOCUMENT, F.xxhash64("text").alias("of"))
    found = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("of") == F.col("kept_of")))
    # equal rows, and rows that differ in other columns than text, stand for each other
    once = found.groupBy("doc_id", "of").agg(F.min(F.struct(*DOCUMENT[1:])).alias("row"))
    return once.select("doc_id", "row.*")


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    found = containment.rows_with_items(docs, table(spark, sf_dir, "benchmark"))
    rows = docs.select(*DOCUMENT, F.xxhash64("text").alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of"))
    return rows.join(found, same, "left_anti").select(*DOCUMENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets in their texts are replaced by a mark, and n_chars follows."""
    masked = docs.select(*DOCUMENT).withColumn("text", secrets.redact(F.col("text")))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its place in a training sequence."""
    return packing.with_checksums(packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_items),
    ("secrets", mask_secrets),
    ("packing", pack),
]

# a learned score, hashed fingerprints and a tokenizer are outside SQL; tests/llm compares by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
