"""Gates for generated rows: shape, length, form, language.  A gate is a column; rejection is counted by the first that fails."""

from __future__ import annotations

import ast
import shutil
import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sieveyard.functions.packs import LanguagePack
from sieveyard.functions.text import sentences
from sieveyard.operators.screen import CJK, MIXED_TAIL, bleed_reason

#: Markdown marks that make an answer structured; a fenced block.
MARKDOWN = r"(?m)\*\*[^*]+\*\*|^\d+\.\s|^[-•] |^#{1,3} "
FENCE = r"(?s)```(\w*)\n(.*?)```"


def n_chars(x: Column) -> Column:
    return F.length(x)


def dots(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("."), F.lit("")))


def short_answer(a: Column) -> Column:
    return (n_chars(a) <= 260) & (dots(a) <= 3) & ~a.rlike(MARKDOWN)


def structured(a: Column) -> Column:
    return a.rlike(MARKDOWN)


def chat(u: Column, a: Column, pro: bool = False) -> Column:
    most, asked = (1200, 160) if pro else (1100, 140)
    return n_chars(a).between(400, most) & (n_chars(u) <= asked) & ~a.rlike(MARKDOWN)


def refusal(a: Column) -> Column:
    return n_chars(a).between(250, 700)


def false_premise(a: Column) -> Column:
    return n_chars(a).between(250, 800)


def alternating(turns: Column, least: int = 4, most: int = 6, shortest: int = 5, longest: int = 1400) -> Column:
    """``least`` to ``most`` turns of user and assistant by turns, a user first, each of fitting length."""
    good = F.transform(turns, lambda t, i: (t["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")) & F.length(t["text"]).between(shortest, longest))
    return F.size(turns).between(least, most) & F.forall(good, lambda x: F.coalesce(x, F.lit(False)))


def parses(lang: str, body: str) -> bool:
    """Whether Python's parser, or Node's where it is installed, takes the text; nothing is run.  Other languages pass."""
    if lang == "python":
        try:
            ast.parse(body)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
    elif lang in ("javascript", "js") and (node := shutil.which("node")):
        return subprocess.run([node, "--check", "-"], input=body.encode(), capture_output=True, timeout=10).returncode == 0
    return True


@F.pandas_udf(BooleanType())
def _all_parse(langs: pd.Series, bodies: pd.Series) -> pd.Series:
    return pd.Series([all(parses(x, y) for x, y in zip(a, b, strict=True)) for a, b in zip(langs, bodies, strict=True)], dtype=bool)


def code_block(a: Column, lang: Column) -> Column:
    """A fenced block must be there, and every block must parse.  A block without a mark is in ``lang``."""
    marks, bodies = (F.coalesce(F.regexp_extract_all(a, F.lit(FENCE), F.lit(k)), F.array().cast("array<string>")) for k in (1, 2))
    langs = F.transform(marks, lambda m: F.lower(F.when(m != "", m).otherwise(F.coalesce(lang, F.lit("")))))
    return (F.size(bodies) > 0) & _all_parse(langs, bodies)


def clean_language(text: Column, pack: LanguagePack, code: bool = False) -> Column:
    """Passes the bleed screen and holds no other script; code loses its fences first and may mix scripts in a word."""
    prose = F.regexp_replace(text, FENCE, " ") if code else text
    ok = bleed_reason(prose, pack).isNull() & ~prose.rlike(CJK)
    return ok if code else ok & ~prose.rlike(MIXED_TAIL)


def paraphrases(variants: Column, pack: LanguagePack, least: int = 8, kept: int = 10) -> tuple[Column, Column]:
    """Whether a pack of variants passes, and the variants kept."""
    first = F.slice(variants, 1, kept)
    return (F.size(variants) >= least) & clean_language(F.array_join(first, " "), pack), first


def choice_shape(choices: Column, answer: Column, n: int = 4) -> Column:
    return (F.size(choices) == n) & answer.isNotNull() & answer.between(0, n - 1)


def edit_length(edited: Column, original: Column, least: float = 0.6, most: float = 1.4) -> Column:
    return (n_chars(edited) >= least * n_chars(original)) & (n_chars(edited) <= most * n_chars(original))


def short_padded(short: Column, padded: Column) -> Column:
    return (n_chars(short) <= 400) & (F.size(sentences(short)) <= 4) & (n_chars(padded) >= 2 * n_chars(short))


def culture(a: Column) -> Column:
    return F.size(sentences(a)).between(2, 12)


def answer_present(solution: Column, answer: Column) -> Column:
    """The answer stands in the solution, decimal commas read as points."""
    return F.replace(solution, F.lit(","), F.lit(".")).contains(answer)


def sft_row(u: Column, a: Column, pack: LanguagePack) -> Column:
    return clean_language(u, pack) & clean_language(a, pack) & (n_chars(a) >= 200)


def depth_flags(rewritten: Column, original: Column, pack: LanguagePack) -> Column:
    """What a rewrite is flagged for; flagged rows are kept."""
    return F.array_compact(F.array(F.when(n_chars(rewritten) < 0.75 * n_chars(original), F.lit("short")), F.when(~clean_language(rewritten, pack), F.lit("bleed"))))


def rejected_valid(rejected: Column, chosen: Column, least: int = 80) -> Column:
    return F.coalesce((F.length(F.trim(rejected)) > 0) & (rejected != chosen) & (n_chars(rejected) >= least), F.lit(False))


def ordered_rejects(rows: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """``reject``: the first gate in the given order that a row does not pass; null if it passes all."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates]
    return rows.withColumn("reject", F.coalesce(*failed, F.lit(None).cast("string")))


def variety_cap(rows: DataFrame, cell: list[str], order: Column, cap: int = 8, existing: DataFrame | None = None) -> DataFrame:
    """At most ``cap`` rows in a cell, counting those that ``existing(cell..., n)`` already holds."""
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*cell).orderBy(order)))
    if existing is None:
        return ranked.where(F.col("__r") <= cap).drop("__r")
    held = existing.groupBy(*cell).agg(F.sum("n").alias("__n"))
    return ranked.join(held, cell, "left").where(F.col("__r") + F.coalesce("__n", F.lit(0)) <= cap).select(*rows.columns)
