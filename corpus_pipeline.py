"""Documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's documents.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import decontaminate, packing, quality, secrets, simhash
from lamella.llm.common import drop_folder, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bands of tokeniser fertility."""
    return quality.rules(docs, lang_col="lang", carry=True).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row with the smallest id.

    Rows are told apart by id and content, so that rows which share an id, or
    have none, are copies only if their texts are; a row with an id goes before
    one without, and of equal rows one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), F.xxhash64(*docs.columns).alias("h"))
    rows = docs.withColumn("_row", key)
    groups = simhash.near_duplicates(rows, "_row", shingle=5, similarity=0.8)
    first = groups.where("_row = component_id").select("_row").distinct()
    return rows.join(first, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), carry=True).where("n_hit = 0").select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, n_chars that of the new text."""
    clean = secrets.redact(secrets.scan(docs, carry=True))
    changed = {"text": F.coalesce("text", "row.text"), "n_chars": F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return clean.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and offsets."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: No stage but the third can be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the table ``documents``.  Each stage's folder goes once the next is written; the last holds the result."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            drop_folder(spark, f"{folder}/{number - 1}")
    return docs
