"""Juries: votes of several judges on a row, missing votes being no votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entails(verdicts: Column, claims: Column, all_supported: Column) -> Column:
    """One voter's yes: a verdict for each claim, all true, and the summary agrees.  Null verdicts give no vote."""
    return F.when(verdicts.isNotNull(), (F.size(verdicts) == F.size(claims)) & F.forall(verdicts, lambda v: F.coalesce(v, F.lit(False))) & F.coalesce(all_supported, F.lit(False)))


def entailment_panel(votes: DataFrame, least: int = 2, allow_single: bool = True) -> DataFrame:
    """``votes(id, vote)`` -> ``id, yes, valid, kept``; a lone valid yes is enough if ``allow_single``."""
    counted = votes.groupBy("id").agg(F.count_if(F.coalesce("vote", F.lit(False))).alias("yes"), F.count("vote").alias("valid"))
    alone = (F.col("valid") == 1) & (F.col("yes") == 1) if allow_single else F.lit(False)
    return counted.withColumn("kept", (F.col("yes") >= least) | alone)


def cold_panel(votes: DataFrame, least: int = 2) -> DataFrame:
    """``votes(id, key, vote)``: answers given without the key -> ``id, agree, valid, outcome``: unresolved, kept or dropped."""
    counted = votes.groupBy("id").agg(F.count_if(F.coalesce(F.col("vote") == F.col("key"), F.lit(False))).alias("agree"), F.count("vote").alias("valid"))
    return counted.withColumn("outcome", F.when(F.col("valid") < 2, "unresolved").when(F.col("agree") >= least, "kept").otherwise("dropped"))


def panel_health(outcomes: DataFrame, most: int = 50, ratio: int = 3) -> DataFrame:
    """Whether a panel must stop: too many rows stay unresolved."""
    n = outcomes.agg(F.count_if(F.col("outcome") == "unresolved").alias("unresolved"), F.count_if(F.col("outcome") != "unresolved").alias("resolved"))
    return n.withColumn("abort", (F.col("unresolved") > most) & (F.col("unresolved") > ratio * F.col("resolved")))


def still_to_do(rows: DataFrame, *done: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id none of the tables has.  Facts pass kept and rejected rows here, questions only the kept."""
    for table in done:
        rows = rows.join(table.select(id_col).distinct(), id_col, "left_anti")
    return rows
