"""Preference pairs, seeded sampling, splits, mixtures by quota and packed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveyard.functions.text import draw, replace_first

#: What a bleed puts in the place of what; kinds of rejected answers and how many of each.
BLEED = (
    ("исто така", "такође"), ("неколку", "неколико"), ("многу", "врло"), ("фала", "хвала"), ("точно", "тачно"),
    ("нешто", "нещо"), ("ништо", "нищо"), ("сакам", "искам"), ("се чувствувам", "се осеќам"),
)
QUOTAS = (("roundtrip", 3300), ("bloat", 2200), ("bleed", 1500))


def chosen_answers(convs: DataFrame, longer_than: int = 150, score: Column | None = None, least: float = 0.02) -> DataFrame:
    """The first user turn followed by an assistant's answer of more than so many characters, for each conversation that has one.

    With a ``score`` only conversations of at least ``least`` count; a null score is 0.
    """
    if score is not None:
        convs = convs.where(F.coalesce(score, F.lit(0.0)) >= least)
    turns = F.col("turns")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(turns) - 1, F.lit(1))), lambda i: F.struct(F.get(turns, i - 1).alias("u"), F.get(turns, i).alias("a")))
    good = F.filter(pairs, lambda p: (p["u"]["role"] == "user") & (p["a"]["role"] == "assistant") & (F.length(p["a"]["text"]) > longer_than))
    return convs.where(F.size(good) > 0).select("conv_id", good[0]["u"]["text"].alias("prompt"), good[0]["a"]["text"].alias("chosen"))


def bleed_rejected(pairs: DataFrame, substitutions: tuple[tuple[str, str], ...] = BLEED, most: int = 3, seed: int = 20260727, id_col: str = "conv_id") -> DataFrame:
    """``rejected``: up to ``most`` substitutions that apply, drawn by the row's id, each at its first place; null if none changes the text."""
    applies = [F.when(F.lower("chosen").contains(a), draw(F.lit(seed), id_col, F.lit(i))) for i, (a, _) in enumerate(substitutions)]
    ranked = F.slice(F.sort_array(F.array_compact(F.array(*applies))), 1, most)
    out = F.col("chosen")
    for key, (a, b) in zip(applies, substitutions, strict=True):
        out = F.when(F.coalesce(F.array_contains(ranked, key), F.lit(False)), replace_first(out, a, b)).otherwise(out)
    return pairs.withColumn("rejected", F.when(out != F.col("chosen"), out))


def hash_order(seed: int, id_col: str) -> list[Column]:
    """An order that looks shuffled and is the same everywhere."""
    return [F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary")), F.col(id_col)]


def quota_kinds(pairs: DataFrame, quotas: tuple[tuple[str, int], ...] = QUOTAS, seed: int = 20260727, done: DataFrame | None = None, id_col: str = "conv_id") -> DataFrame:
    """``kind`` by consecutive quotas in seeded order; rows already done use up their place but are not returned."""
    total = sum(n for _, n in quotas)
    first = pairs.orderBy(*hash_order(seed, id_col)).limit(total).select(id_col)
    ranked = first.withColumn("pos", F.row_number().over(Window.orderBy(*hash_order(seed, id_col))))
    kind, at = F.lit(None).cast("string"), total
    for name, n in reversed(quotas):
        at -= n
        kind = F.when((F.col("pos") > at) & (F.col("pos") <= at + n), F.lit(name)).otherwise(kind)
    out = ranked.withColumn("kind", kind)
    return out if done is None else out.join(done.select(id_col), id_col, "left_anti")


def seeded_sample(rows: DataFrame, k: int, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """``k`` rows without replacement, in seeded order."""
    return rows.orderBy(*hash_order(seed, id_col)).limit(k)


def frozen_split(rows: DataFrame, held_out: int = 500, seed: int = 20260727, id_col: str = "doc_id") -> DataFrame:
    """``split``: ``holdout`` for the first rows in seeded order, ``train`` for all others."""
    chosen = seeded_sample(rows.select(id_col), held_out, seed, id_col).withColumn("split", F.lit("holdout"))
    return rows.join(chosen, id_col, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def assert_disjoint(train: DataFrame, held_out: DataFrame, id_col: str) -> DataFrame:
    """The training rows that the hold-out has too; an empty result is the assertion."""
    return train.join(held_out.select(id_col), id_col, "left_semi")


def weighted_choice(rows: DataFrame, weights: list[tuple[str, float]], seed: int, id_col: str = "doc_id", as_: str = "choice") -> DataFrame:
    """One of the names for each row, by weight, from a number drawn by the row's id."""
    total, upto = sum(w for _, w in weights), 0.0
    u = draw(F.lit(seed), id_col) / F.lit(4294967296.0)
    choice = F.lit(weights[-1][0])
    bounds = []
    for name, w in weights:
        upto += w / total
        bounds.append((name, upto))
    for name, bound in reversed(bounds[:-1]):
        choice = F.when(u < bound, F.lit(name)).otherwise(choice)
    return rows.withColumn(as_, choice)


def anchors(convs: DataFrame, least: int = 600, most: int = 1200, n: int = 3) -> DataFrame:
    """The first conversations of two turns with an answer of fitting length."""
    return convs.where((F.size("turns") == 2) & F.length(F.get("turns", F.lit(1))["text"]).between(least, most)).orderBy("conv_id").limit(n).select("conv_id")


def running_total(rows: DataFrame, group: list[str], order: list[str | Column], amount: str, as_: str, bucket: Column) -> DataFrame:
    """Running sums within groups in two passes: sums of ordered buckets, then within each bucket.

    ``bucket`` must not fall along the order.
    """
    bucketed = rows.withColumn("__bucket", bucket)
    sums = bucketed.groupBy(*group, "__bucket").agg(F.sum(amount).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__before", before).drop("__sum")
    within = F.sum(amount).over(Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return bucketed.withColumn("__within", within).join(sums, [*group, "__bucket"]).withColumn(as_, F.col("__before") + F.col("__within")).drop("__bucket", "__within", "__before")


def token_mixture(docs: DataFrame, shares: list[tuple[str, float]], budget: int, source_col: str = "source", tokens_col: str = "n_tokens", id_col: str = "doc_id") -> DataFrame:
    """Rows of each source in order of id as long as their tokens stay within the source's share of the budget."""
    quota = F.lit(None).cast("double")
    for name, share in shares:
        quota = F.when(F.col(source_col) == name, F.lit(share * budget)).otherwise(quota)
    summed = running_total(docs.where(quota.isNotNull()), [source_col], [id_col], tokens_col, "upto", F.floor(F.col(id_col) / 65536))
    return summed.where(F.col("upto") <= quota)


def oversample(rows: DataFrame, native: Column, times: int = 3) -> DataFrame:
    """Native rows ``times`` over; ``copy`` numbers them."""
    return rows.withColumn("copy", F.explode(F.when(native, F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1)))))


def packed_blocks(docs: DataFrame, size: int, shard: Column, tokens_col: str = "n_tokens", id_col: str = "doc_id") -> DataFrame:
    """Documents and their end marks laid end to end in each shard and cut into blocks of ``size``; the tail is dropped.

    One row for each part of a document in a block: ``shard, block, doc_id, at, length`` with ``at`` the part's place in the block.
    """
    sized = docs.select(shard.alias("shard"), F.col(id_col), (F.col(tokens_col) + 1).cast("long").alias("n"))
    placed = running_total(sized, ["shard"], [id_col], "n", "stop", F.floor(F.col(id_col) / 65536)).withColumn("start", F.col("stop") - F.col("n"))
    totals = sized.groupBy("shard").agg(F.floor(F.sum("n") / size).alias("blocks"))
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size)))).join(totals, "shard").where(F.col("block") < F.col("blocks"))
    start, stop = F.greatest("start", F.col("block") * size), F.least("stop", (F.col("block") + 1) * size)
    return cut.select("shard", "block", id_col, (start - F.col("block") * size).alias("at"), (stop - start).alias("length"))
