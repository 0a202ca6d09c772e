"""Documents to packed training sequences, in five stages.

Each stage takes what the one before has kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveyard.llm.language_id import UNKNOWN, fit, identify
from sieveyard.llm.near_duplicates import near_duplicates
from sieveyard.llm.packing import pack
from sieveyard.llm.source_mix import take_mix
from sieveyard.llm.staging import stage
from sieveyard.llm.substring_duplicates import remove_repeats

#: A text whose best language has less than this posterior probability is rejected.
LEAST_CONFIDENCE = 0.5
#: Words of a near-duplicate shingle, similarity of near duplicates, words of a repeated passage.
SHINGLE, SIMILARITY, PASSAGE = 5, 0.8, 50


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no language: null, without a letter, or torn between languages.  Without labels only letters count."""
    model = fit(docs)
    named = identify(docs, model, lang_as="__lang", score_as="__score")
    if model.languages:
        return named.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= LEAST_CONFIDENCE)).select(*docs.columns)
    return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays; rows that share an id stay or go together."""
    near = near_duplicates(docs, k=SHINGLE, threshold=SIMILARITY)
    gone = near.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start earlier elsewhere go; documents of which no word is left go with them."""
    cut = remove_repeats(docs, window=PASSAGE, words_as="__words", removed_as="__removed", leave_untouched=True)
    left = cut.where((F.col("__removed") == 0) | (F.col("__removed") < F.col("__words")))
    return left.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its share by the square root of its size, until one has nothing left; rows that share the id at a source's cut all stay.

    A null source is a source of its own, an empty table gives an empty one.
    """
    return take_mix(docs, block_rows=16, period=2048, minor=0.1)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document.  A null or empty text is a piece with the end token alone; repeated rows and null ids are documents like others."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix),
    ("best_fit_packing", pack_sequences),
]

#: SQL has no words for the tokenizer, the model or the components; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
