"""The corpus operators as registered queries: thin, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chunk_bpe, collocations, exact_dedup, hard_negatives, maxent_lm, packing, quality, secrets, simhash, substring_dedup, token_store, toxicity, vector_search
from .common import documents
from .wordbpe import vocabulary_path

WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), _table(spark, sf_dir, "labels"), 0.3)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir), "doc_id", "text"))


def op3_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode_decode(documents(spark, sf_dir), vocabulary_path(WORDS))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir), "largest").drop("row_hash")


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(documents(spark, sf_dir), 7, 2)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), 3, 3)


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"), 5, 50, 256)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), _table(spark, sf_dir, "labels"), 0.5)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(documents(spark, sf_dir), vocabulary_path(WORDS), 1)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path(BYTES), 1, 2048)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.without_repeats(documents(spark, sf_dir), 20))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved), 100, 5, 5, 80, 100, 256)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir), 4, 30, 2_000_000, 80, 2000)


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_secrets": op2_secrets,
        "op3_chunk_bpe": op3_chunk_bpe,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_maxent_lm": op5_maxent_lm,
        "op6_simhash": op6_simhash,
        "op7_top_k": op7_top_k,
        "op8_toxicity": op8_toxicity,
        "op9_token_files": op9_token_files,
        "op10_packing": op10_packing,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_collocations": op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": secrets.SECRETS_SQL, "op4_exact_dedup": exact_dedup.DEDUP_SQL, "op7_top_k": vector_search.TOP_K_SQL, "op11_substring_dedup": substring_dedup.REPEATS_SQL, "op12_hard_negatives": hard_negatives.MINE_SQL, "op13_collocations": collocations.PHRASES_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
