"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Stored, semi_filter, table
from sparkloom.llm.hyperminhash import near_duplicates
from sparkloom.llm.packing import pack
from sparkloom.llm.quality_rules import judged
from sparkloom.llm.toxicity import classify


def _without(spark: SparkSession, docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """docs without the rejected doc_ids; rows of null doc_id stay."""
    ids = Stored(spark).put(name, rejected.where("doc_id is not null").select("doc_id").distinct())
    return semi_filter(docs, ids, "doc_id", anti=True).select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't call toxic."""
    rows = classify(spark, docs, table(spark, sf_dir, "labels"))
    return _without(spark, docs, rows.where("is_toxic"), "pl_toxic")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the risk-controlled thresholds."""
    rows = judged(spark, docs, table(spark, sf_dir, "labels"))
    return _without(spark, docs, rows.where("not kept"), "pl_quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked by a similarity of 0.8 or more of five-word shingles."""
    rows = near_duplicates(spark, docs, k=5, percent=80)
    return _without(spark, docs, rows.where("not kept"), "pl_copies")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return pack(spark, docs)


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("MinHash near-dedup", near_dedup), ("best-fit packing", packing)]

#: Models, sketches and tokenizers can't be expressed in SQL; tests/llm/test_pipeline.py checks each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over what its predecessor has written."""
    kept = Stored(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = kept.put(f"pl_stage{k}", stage(spark, docs, sf_dir))
        if k:
            kept.drop(f"pl_stage{k - 1}")
    return docs
