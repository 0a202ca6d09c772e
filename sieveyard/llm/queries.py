"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from sieveyard.llm import class_lm, embedding_duplicates, exact_topk, language_id, main_text, near_duplicates, oracles, packing, source_mix, substring_duplicates, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int) -> Column:
    """crc32 of doc_id as text, modulo ``of``; a null id falls in fold -1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(-1))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(4) == 2)
    model = language_id.fit(docs, train=~F.col("held_out"))
    return language_id.identify(docs, model, lang_as="lang_pred", score_as="score", keep=["doc_id", "held_out"])


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=0.8)


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.class_lm(table(spark, sf_dir, "documents"), train=fold(10) != 0)


def op6_substring_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_duplicates.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mix.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"), block_rows=16, period=2048, minor=0.1)
    return out.select("doc_id", "source", "block", "slot", "kept")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates.embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_source_mix": op2_source_mix,
    "op5_class_lm": op5_class_lm,
    "op6_substring_duplicates": op6_substring_duplicates,
    "op9_embedding_duplicates": op9_embedding_duplicates,
    "op10_exact_topk": op10_exact_topk,
    "op1_language_id": op1_language_id,
    "op4_near_duplicates": op4_near_duplicates,
    "op7_main_text": op7_main_text,
    "op3_token_counts": op3_token_counts,
    "op8_best_fit_packing": op8_best_fit_packing,
}

ORACLES: dict[str, str] = {
    "op2_source_mix": source_mix.ORACLE.format(period=2048, block=16, minor=0.1),
    "op4_near_duplicates": oracles.NEAR_DUPLICATES,
    "op6_substring_duplicates": oracles.SUBSTRING_DUPLICATES,
    "op9_embedding_duplicates": oracles.EMBEDDING_DUPLICATES,
    "op10_exact_topk": oracles.EXACT_TOPK,
}
