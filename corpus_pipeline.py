"""The corpus pipeline: documents in, packed training sequences out.

Each stage reads what the one before it wrote. Toxic documents go, then all but the smallest id of equal texts, then
all but one of each group of near-duplicates, then documents that hold a benchmark item; what stays is packed. Rows are
dropped one by one, by their own text, so rows that repeat an id, or have none, are documents of their own. Other columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from placewright.llm.decontaminate import drop_contaminated
from placewright.llm.exact_dedup import drop_copies
from placewright.llm.near_dedup import drop_near_duplicates
from placewright.llm.packing import PACKED, pack, tokenizer_path
from placewright.llm.toxicity import drop_toxic
from placewright.tables import shared_folder

#: The stages learn and pack, which no SQL expresses.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a model of the labels predicts to be toxic; it scores null texts as empty ones. Without labels of both kinds all have one score."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each text up to blanks: the smallest id, null last. A null text is an empty one. Rows are judged by their texts, whatever their ids."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of docs for each group of near-duplicates: the smallest id, null last. Null and empty texts resemble nothing."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose text holds a benchmark item; null and empty texts hold none."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in their sequences; a null or empty text is the closing id alone."""
    return pack(docs, tokenizer_path()).select(*PACKED)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
