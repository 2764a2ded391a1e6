"""Documents to packed training sequences: quality rules, near-duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``. Between stages the
documents are written as Parquet in the cluster's shared folder and read again.
No documents give no rows at any stage; columns beyond those of ``documents`` are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import stored, table
from roadloom.llm.minhash import near_duplicates
from roadloom.llm.mixture import mixed_documents
from roadloom.llm.packing import pack_documents
from roadloom.llm.quality import good_documents
from roadloom.llm.queries import tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts fail the base rule; rows that repeat are judged each; labels of a null doc_id count for nothing."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8): that with the smallest id, null last.

    Rows have numbers of their own here, so copies that share a doc_id or have none go
    too. Documents without words are in no group and stay.
    """
    row = "__roadloom_row"
    docs_ = stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows", "snappy")
    groups = near_duplicates(docs_.select(F.col(row).alias("doc_id"), "text"), shingle=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("member"), "component_id").join(docs_.select("doc_id", F.col(row).alias("member")), "member")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "member"))["member"]
    stays = groups.groupBy("component_id").agg(first.alias("stays")).select("stays")
    return docs_.join(stays, docs_[row] == stays["stays"], "left_semi").select(docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. Null and empty texts have no words; rows that repeat share a decision."""
    return mixed_documents(docs, weights=(3, 1, 2), share=1.5, repeats=2)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place; a null text is the end id alone, a row of a repeated or null doc_id a document each."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixture", source_mixture),
    ("best_fit_packing", best_fit_packing),
]

#: Near-duplicates and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}", "snappy")
    return docs
