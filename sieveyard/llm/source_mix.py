"""Mixing sources to target weights by Pfair scheduling.

A source of weight w owes a block of rows in every window [floor(j / w), ceil((j + 1) / w)): the window gives block j's release and
deadline.  Earliest deadline first among the released blocks meets every deadline when the weights sum to 1, so at any
slot each source is less than one block off its target.  Weights are whole numbers of slots in a period; the
schedule of one period, made by a SQL aggregate over its slots, repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ADDED = ("block", "slot", "kept")


def schedule(shares: DataFrame, period: int) -> DataFrame:
    """``shares(key, k)``, whole shares that sum to ``period`` -> ``(key, k, j, at)``: the slot of each source's jth block.

    One row of at most ``period`` sources is scheduled by one expression; ties go to the source first in order.
    """
    one = shares.where("k > 0").agg(F.sort_array(F.collect_list(F.struct("key", "k"))).alias("sources"))
    length = F.lit(period)

    def step(state: Column, t: Column) -> Column:
        jobs = F.transform("sources", lambda s, i: F.struct(
            F.ceil((F.element_at(state["done"], i + 1) + 1) * length / s["k"]).alias("deadline"), i.alias("i"),
            (F.floor(F.element_at(state["done"], i + 1) * length / s["k"]) <= t).alias("released"),
        ))
        chosen = F.array_min(F.transform(F.filter(jobs, lambda x: x["released"]), lambda x: F.struct(x["deadline"], x["i"])))["i"]
        return F.struct(
            F.transform(state["done"], lambda n, i: n + F.when(i == chosen, 1).otherwise(0)).alias("done"),
            F.concat(state["order"], F.array(F.struct(chosen.alias("i"), F.element_at(state["done"], chosen + 1).alias("j"), t.alias("at")))).alias("order"),
        )

    empty = F.struct(F.transform("sources", lambda s: F.lit(0)).alias("done"), F.expr("cast(array() as array<struct<i: int, j: int, at: int>>)").alias("order"))
    slots = F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), empty, step, lambda state: state["order"])
    laid = one.where(F.size("sources") > 0).select("sources", F.explode(slots).alias("x"))
    source = F.element_at("sources", F.col("x.i") + 1)
    return laid.select(source["key"].alias("key"), source["k"].alias("k"), F.col("x.j").alias("j"), F.col("x.at").alias("at"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 16, period: int = 2048, minor: float = 0.1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``block``, ``slot`` and ``kept``.

    Rows of a source are in order of md5 of their id and cut into blocks of ``block_rows``; ``block`` counts them and ``slot`` is the
    block's place in the mix.  ``weights`` (by default the square roots of the sources' row counts) are rounded to whole slots of a period,
    at least one for each source that has a weight.  The mix ends at the first slot for which a source has no block left:
    ``kept`` says which rows come before.  So to its end each source is less than one block off its rounded weight, and sources of equal rows and weights
    give all their rows.  Only a source whose weight is under ``minor`` of an even share does not end the mix: it gives all it has and then leaves its slots empty,
    so that one stray row with a source of its own does not end it.

    A null source is a source of its own.  Sources that ``weights`` does not name get no slot (null) and are not kept.  A null
    id sorts first; rows with equal ids are told apart by no order but each has its place.  Other columns pass; columns named as the new ones are
    replaced.  More sources than half of a period's slots raise an error; a longer period takes more.

    Native throughout.  Ranks are taken in buckets of the md5, so that a source with a third of all rows is no single
    task; only sums by source and bucket are added up.
    """
    kept_columns = [c for c in docs.columns if c not in _ADDED]
    key = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0"))
    rows = docs.select(*kept_columns, key.alias("__key"), F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit("")).alias("__md5"))
    counts = rows.groupBy("__key").agg(F.count("*").alias("n"))
    # hex digits that make a bucket: about 100,000 rows in each, were all rows of one source
    digits = F.lit(2) + F.floor(F.log(16.0, F.greatest(F.lit(1.0), F.sum("n").over(Window.partitionBy()) / 25_600_000.0))).cast("int")
    if weights is None:
        weight = F.floor(F.sqrt("n") * 1000)
    else:
        named = F.create_map(*[F.lit(x) for s, w in sorted(weights.items()) for x in ("1" + s, int(w * 1_000_000))]) if weights else F.create_map(F.lit(""), F.lit(0))
        weight = F.coalesce(named[F.col("__key")], F.lit(0)).cast("long")
    everywhere = Window.partitionBy()
    weighed = counts.select("__key", "n", digits.alias("digits"), weight.alias("w")).where("w > 0")
    sources = F.count("*").over(everywhere)
    free = F.when(sources <= period // 2, F.lit(period) - sources).otherwise(F.raise_error(F.concat(F.lit("a period of %d slots is too short for this number of sources: " % period), sources.cast("string"))).cast("long"))
    parts = weighed.withColumn("total", F.sum("w").over(everywhere)).withColumn("whole", F.expr("w * (%d - count(*) over ()) div total" % period)).withColumn("rest", F.expr("w * (%d - count(*) over ()) %% total" % period))
    spare = free - F.sum("whole").over(everywhere)
    ranked = parts.withColumn("spare", spare).withColumn("r", F.row_number().over(Window.partitionBy().orderBy(F.col("rest").desc(), "__key")))
    shares = ranked.withColumn("even", F.avg("w").over(everywhere)).select("__key", "n", "w", "even", "digits", (1 + F.col("whole") + F.when(F.col("r") <= F.col("spare"), 1).otherwise(0)).cast("long").alias("k"))
    slots = schedule(shares.select(F.col("__key").alias("key"), "k"), period)
    # the first block that a source lacks, of all sources but minor ones
    lacking = shares.where(F.col("w") >= minor * F.col("even")).withColumn("next", F.ceil(F.col("n") / block_rows)).select(F.col("__key").alias("key"), "next", F.expr("cast(next % k as int)").alias("j"))
    horizon = slots.join(F.broadcast(lacking), ["key", "j"]).agg(F.min(F.expr("next div k") * period + F.col("at")).alias("slots"))

    digits_of = F.broadcast(counts.select(digits.alias("__digits")).limit(1))
    bucketed = rows.crossJoin(digits_of).withColumn("__bucket", F.expr("substring(__md5, 1, __digits)")).drop("__digits")
    sums = bucketed.groupBy("__key", "__bucket").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("__before", before).join(F.broadcast(shares.select("__key", "k")), "__key", "left").select("__key", "__bucket", "__before", F.col("k").alias("__k"))
    within = F.row_number().over(Window.partitionBy("__key", "__bucket").orderBy("__md5", id_col)) - 1
    placed = bucketed.withColumn("__within", within).join(offsets, ["__key", "__bucket"])
    placed = placed.withColumn("block", F.floor((F.col("__before") + F.col("__within")) / block_rows)).withColumn("__j", F.expr("cast(block % __k as int)"))
    pattern = F.broadcast(slots.select(F.col("key").alias("__key"), F.col("j").alias("__j"), F.col("at").alias("__at")))
    laid = placed.join(pattern, ["__key", "__j"], "left").withColumn("slot", F.expr("block div __k") * period + F.col("__at"))
    cut = laid.crossJoin(F.broadcast(horizon))
    return cut.select(*kept_columns, "block", "slot", F.coalesce(F.col("slot") < F.col("slots"), F.lit(False)).alias("kept"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that ``mix_sources`` keeps, with the columns of ``docs``.

    The mix is laid over ids and sources alone.  What it keeps of a source are its first rows by md5 of the id, so one cut for
    each source selects them and no text moves.  Rows that share the id at the cut all stay.
    """
    key = F.coalesce(F.concat(F.lit("1"), F.col(source_col).cast("string")), F.lit("0"))
    mark = F.coalesce(F.md5(F.col(id_col).cast("string").cast("binary")), F.lit(""))
    mixed = mix_sources(docs.select(id_col, source_col), id_col=id_col, source_col=source_col, **options)
    cuts = mixed.where("kept").groupBy(key.alias("__key")).agg(F.max(mark).alias("__cut"))
    cut = docs.withColumn("__key", key).join(F.broadcast(cuts), "__key").where(mark <= F.col("__cut"))
    return cut.select(*docs.columns)


#: The same in DuckDB's SQL over ``documents``, for the default weights and the given constants.
ORACLE = """
with recursive sized as (
  select coalesce('1' || source, '0') as key, count(*) as n from documents group by 1
), weighed as (
  select key, n, cast(floor(sqrt(n) * 1000) as bigint) as w from sized
), parts as (
  select key, n, w, (w * ({period} - count(*) over ())) // sum(w) over () as whole, (w * ({period} - count(*) over ())) % sum(w) over () as rest from weighed
), ranked as (
  select *, {period} - count(*) over () - sum(whole) over () as spare, row_number() over (order by rest desc, key) as r from parts
), shares as (
  select key, n, w, avg(w) over () as even, cast(1 + whole + case when r <= spare then 1 else 0 end as bigint) as k from ranked
), edf as (
  select 0 as t, key, k, 0 as done, false as ran from shares
  union all
  select t + 1, key, k, done + case when chosen then 1 else 0 end, chosen from (
    select t, key, k, done, key = first_value(key) over (order by case when done * {period} // k <= t then 0 else 1 end, ((done + 1) * {period} + k - 1) // k, key) as chosen from edf
  ) where t < {period}
), slots as (
  select key, k, cast(done - 1 as bigint) as j, t - 1 as at from edf where ran
), lacking as (
  select key, k, (n + {block} - 1) // {block} as next from shares where w >= {minor} * even
), horizon as (
  select min((next // l.k) * {period} + x.at) as slots from lacking l join slots x on x.key = l.key and x.j = next % l.k
), placed as (
  select doc_id, source, coalesce('1' || source, '0') as key,
    (row_number() over (partition by coalesce('1' || source, '0') order by coalesce(md5(cast(doc_id as varchar)), ''), doc_id nulls first) - 1) // {block} as block
  from documents
)
select p.doc_id, p.source, p.block, (p.block // s.k) * {period} + x.at as slot, (p.block // s.k) * {period} + x.at < h.slots as kept
from placed p join shares s using (key) join slots x on x.key = p.key and x.j = p.block % s.k cross join horizon h
"""
