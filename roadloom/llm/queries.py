"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    from roadloom.llm.tokens import file_text

    return file_text(public_tokenizers.path(name))


def op1_sorted_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.llm.mixture import mixed_counts

    return mixed_counts(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, repeats=2)


def op3_resynchronised_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op4_simple8b_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.llm.token_store import stored_tokens

    return stored_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op5_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.llm.quality import quality_verdicts

    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=4096, end_id=1)


def op7_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.llm.context_mixing import language_scores

    return language_scores(table(spark, sf_dir, "documents"), folds=7, held=2)


def op8_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.llm.ring import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"), min_bytes=0).drop("url")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roadloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from roadloom.llm.oracles import SQL

    return dict(SQL)
