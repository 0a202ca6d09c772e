"""Sources."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sieveyard.functions.packs import LanguagePack


def jsonl(spark: SparkSession, path: str, schema: StructType | str, sources: list[str] | None = None, source_col: str = "source", parts: int | None = None) -> DataFrame:
    """Rows of JSON lines, plain or gzip; blank lines are skipped, broken ones raise.

    A gzip file is one task: ``parts`` deals its rows out again.  ``sources`` keeps rows of these sources.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if sources is not None:
        rows = rows.where(F.col(source_col).isin(sources))
    return rows.repartition(parts) if parts else rows


def field(spark: SparkSession, path: str, name: str = "text") -> DataFrame:
    """One text field of JSON lines, nulls left out."""
    return spark.read.schema(f"`{name}` string").json(path).where(F.col(name).isNotNull())


def tsv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One column by header name; quotes are text, short rows give null, blanks are left out."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return rows.select(name).where(F.trim(F.col(name)) != "")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Shards by glob."""
    return spark.read.parquet(path)


def terms(spark: SparkSession, path: str) -> DataFrame:
    """Lower-cased lines without blanks and comments, each once."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def approved_pack(spark: SparkSession, pack: LanguagePack, path: str) -> LanguagePack:
    """The pack's own terms and those of an approved list, which people read and so is short."""
    return pack.with_terms(r["term"] for r in terms(spark, path).collect())


def markdown_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of headings ``## id ...``, in files of any size taken whole."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?m)^## id (\S+)"), F.lit(1))).alias("id"))


def matrix_index(spark: SparkSession, path: str) -> DataFrame:
    """Passages and their vectors, as the sink of that name writes them."""
    return spark.read.parquet(path)


def topics(path: str) -> dict[str, dict]:
    """Categories of a two-level YAML file: ``subtopics`` as a list, ``count`` as a number, other keys as text.

    A settings file of some lines, read where the job starts.
    """
    out: dict[str, dict] = {}
    here: dict | None = None
    listed: list | None = None
    for raw in Path(path).read_text(encoding="utf-8").splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        item = re.match(r"\s*-\s+(.*)", line)
        if item and listed is not None:
            listed.append(item[1].strip("\"' "))
            continue
        key, _, value = line.strip().partition(":")
        value = value.strip().strip("\"'")
        if indent == 0:
            here = out.setdefault(key, {})
            listed = None
        elif here is not None:
            if value == "":
                listed = here.setdefault(key, [])
            elif value.startswith("["):
                here[key] = [x.strip("\"' ") for x in value.strip("[]").split(",") if x.strip()]
            else:
                here[key] = int(value) if value.isdigit() else value
    return out
