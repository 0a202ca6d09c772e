"""Arithmetic problems by template, their answers right by construction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveyard.functions.text import draw, number_text

KINDS = ("pct", "prop", "speed", "area", "split", "discount", "avg", "interest", "mix", "time")


def _between(name: str, low: int, high: int) -> Column:
    return draw(F.lit(name), "seed", "id") % (high - low + 1) + low


def _one_of(name: str, *values: int) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (draw(F.lit(name), "seed", "id") % len(values)).cast("int") + 1)


def problems(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """``id, kind, problem, working, answer``: ``n`` problems, all arithmetic in whole numbers or exact hundredths.

    Parameters come from md5 of the seed, the id and their name, so that each problem can be made again alone.
    """
    rows = spark.range(n).select("id", F.lit(seed).alias("seed"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (draw(F.lit("kind"), "seed", "id") % len(KINDS)).cast("int") + 1)
    # fixed values: the ranges of the parameters
    rows = rows.withColumn("kind", kind).select(
        "id", "kind", "seed",
        (_one_of("base", 120, 240, 360, 450, 800, 1200, 2500, 3600) + 10 * _between("base+", 0, 24)).alias("base"), _one_of("pct", 5, 8, 12, 15, 20, 25, 35, 40, 45, 60, 75).alias("pct"),
        _between("workers", 2, 14).alias("workers"), _between("days", 3, 25).alias("days"), _between("jobs", 4, 40).alias("jobs"),
        _one_of("hours", 2, 3, 4, 5, 6, 8).alias("hours"), _between("pace", 15, 95).alias("pace"), _between("long", 4, 60).alias("long"), _between("wide", 3, 45).alias("wide"),
        _one_of("people", 3, 4, 5, 6, 8, 12).alias("people"), _between("each", 40, 900).alias("each"), (50 * _between("price", 6, 240)).alias("price"), _one_of("off", 10, 15, 20, 25, 30, 40, 45, 55, 70).alias("off"),
        _one_of("count", 3, 4, 5, 6, 7).alias("count"), (1000 * _between("stake", 5, 150)).alias("stake"), _one_of("rate", 2, 3, 4, 5, 6, 7, 8).alias("rate"), _one_of("years", 2, 3, 4, 5, 6, 10).alias("years"),
        _between("kg1", 2, 40).alias("kg1"), _between("kg2", 2, 40).alias("kg2"), (10 * _between("per1", 3, 40)).alias("per1"), (10 * _between("per2", 4, 55)).alias("per2"),
        _between("hour", 1, 11).alias("hour"), _between("minute", 1, 59).alias("minute"), _between("add", 15, 260).alias("add"),
    )
    rows = rows.withColumn("values", F.transform(F.sequence(F.lit(1), F.col("count")), lambda i: draw(F.lit("value"), "seed", "id", i) % 119 + 2))
    total = F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x)
    late = F.col("hour") * 60 + F.col("minute") + F.col("add")
    say = lambda text, *cols: F.format_string(text, *[F.col(c) if isinstance(c, str) else c for c in cols])
    texts = {
        "pct": (say("What is %d%% of %d?", "pct", "base"), number_text(F.col("base") * F.col("pct") / 100)),
        "prop": (say("%d workers take %d days for a job. How many days do they take for %d such jobs?", "workers", "days", "jobs"), (F.col("jobs") * F.col("days")).cast("string")),
        "speed": (say("A car covers %d km in %d hours. What is its mean speed?", F.col("hours") * F.col("pace"), "hours"), F.col("pace").cast("string")),
        "area": (say("A field is %d m long and %d m wide. What is its area?", "long", "wide"), (F.col("long") * F.col("wide")).cast("string")),
        "split": (say("%d coins are dealt evenly to %d people. How many does each get?", F.col("people") * F.col("each"), "people"), F.col("each").cast("string")),
        "discount": (say("A product costs %d and is %d%% off. What does it cost now?", "price", "off"), number_text(F.col("price") * (100 - F.col("off")) / 100)),
        "avg": (F.concat(F.lit("What is the mean of "), F.array_join("values", ", "), F.lit("?")), number_text(total / F.col("count"))),
        "interest": (say("A deposit of %d bears %d%% simple interest a year. How much interest is that in %d years?", "stake", "rate", "years"), number_text(F.col("stake") * F.col("rate") * F.col("years") / 100)),
        "mix": (say("You buy %d kg at %d and %d kg at %d. What do you pay?", "kg1", "per1", "kg2", "per2"), (F.col("kg1") * F.col("per1") + F.col("kg2") * F.col("per2")).cast("string")),
        "time": (say("A trip begins at %d:%02d and takes %d minutes. When does it end?", "hour", "minute", "add"), F.format_string("%d:%02d", F.floor(late / 60), late % 60)),
    }
    steps = {
        "pct": say("%d * %d / 100", "base", "pct"), "prop": say("%d * %d", "jobs", "days"), "speed": say("%d / %d", F.col("hours") * F.col("pace"), "hours"), "area": say("%d * %d", "long", "wide"),
        "split": say("%d / %d", F.col("people") * F.col("each"), "people"), "discount": say("%d - %d * %d / 100", "price", "price", "off"),
        "avg": F.concat(F.lit("("), F.array_join("values", " + "), F.lit(") / "), F.col("count").cast("string")), "interest": say("%d * %d / 100 * %d", "stake", "rate", "years"),
        "mix": say("%d * %d + %d * %d", "kg1", "per1", "kg2", "per2"), "time": say("%d:%02d + %d min", "hour", "minute", "add"),
    }
    problem = answer = working = F.lit(None).cast("string")
    for name, (p, a) in texts.items():
        here = F.col("kind") == name
        problem, answer, working = F.when(here, p).otherwise(problem), F.when(here, a).otherwise(answer), F.when(here, steps[name]).otherwise(working)
    return rows.select("id", "kind", problem.alias("problem"), F.concat(working, F.lit(" = "), answer).alias("working"), answer.alias("answer"))
