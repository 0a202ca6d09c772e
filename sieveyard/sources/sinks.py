"""Sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matrix_index(passages: DataFrame, vectors: DataFrame, path: str, key: str = "passage_id") -> None:
    """Passages and their vectors as one table in order of key, so that a reader finds a passage by the files' ranges.

    Passages without a vector and vectors without a passage are left out.
    """
    passages.join(vectors, key).repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def split(judged: DataFrame, kept: str, dropped: str, reason: str = "reason") -> None:
    """Kept rows without the reason, dropped ones with it."""
    judged.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").json(kept)
    judged.where(F.col(reason).isNotNull()).write.mode("overwrite").json(dropped)


def stats(judged: DataFrame, reason: str = "reason") -> DataFrame:
    return judged.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def review(rows: DataFrame, path: str, title: str, id_col: str, text: Column, order: list[Column], n: int = 300) -> None:
    """A sample for people: ``n`` rows, each under a heading ``## id ...``."""
    picked = rows.select(F.col(id_col).alias("id"), text.alias("text"), *[c.alias(f"__{i}") for i, c in enumerate(order)]).orderBy(*[f"__{i}" for i in range(len(order))]).limit(n).collect()
    Path(path).write_text(f"# {title}\n\n" + "\n".join(f"## id {r['id']}\n\n{r['text']}\n" for r in picked), encoding="utf-8")


def census_markdown(tables: dict[str, DataFrame], path: str) -> None:
    """A table for each census, aggregates only."""
    out = []
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(x) for x in r) + " |" for r in df.collect()] + [""]
    Path(path).write_text("\n".join(out), encoding="utf-8")
