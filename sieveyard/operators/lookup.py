"""Passages for topics, keyed overrides, exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topic_passages(topics: DataFrame, docs: DataFrame, head: int = 100, least: int = 600, cut: int = 2500, mode: str = "longest") -> DataFrame:
    """``topic, doc_id, passage``: for each topic a text that names it among its first ``head`` characters, cut to ``cut``.

    ``longest`` takes the longest text, ties to the smallest id.  ``reference`` compares full lengths with the cut text kept so far:
    once there are texts over ``cut`` the last of them by id wins, else the first longest.
    Topics are a short list and go to every task as one row.
    """
    names = topics.select(F.lower("topic").alias("key"), "topic").agg(F.collect_list(F.struct("key", "topic")).alias("topics"))
    rows = docs.where(F.length("text") > least).select("doc_id", "text", F.lower(F.substring("text", 1, head)).alias("start")).crossJoin(F.broadcast(names))
    met = rows.select("doc_id", F.length("text").alias("n"), F.substring("text", 1, cut).alias("passage"), F.explode(F.filter("topics", lambda t: F.col("start").contains(t["key"]))).alias("t"))
    if mode == "longest":
        rank = F.struct("n", -F.col("doc_id"))
    else:
        over = (F.col("n") > cut).cast("int")
        rank = F.struct(over, F.when(over == 1, F.col("doc_id")).otherwise(F.col("n")), -F.col("doc_id"))
    return met.groupBy("t.topic").agg(F.max_by("doc_id", rank).alias("doc_id"), F.max_by("passage", rank).alias("passage"))


def override(base: DataFrame, curated: DataFrame, key: str, value: str) -> DataFrame:
    """All keys of both; the curated value where there is one."""
    c = curated.select(F.col(key), F.col(value).alias("__curated"), F.lit(True).alias("__has"))
    out = base.join(c, key, "full_outer")
    return out.select(key, F.when(F.col("__has"), F.col("__curated")).otherwise(F.col(value)).alias(value))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, first_id, kept``: rows with equal texts, found by a hash of the text and the text; null texts are all kept."""
    firsts = docs.where(F.col(text_col).isNotNull()).groupBy(F.sha2(F.col(text_col).cast("binary"), 256).alias("h")).agg(F.min(id_col).alias("first_id"))
    out = docs.select(id_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("h")).join(firsts, "h", "left")
    first = F.coalesce("first_id", F.col(id_col))
    return out.select(id_col, first.alias("first_id"), (first == F.col(id_col)).alias("kept"))
