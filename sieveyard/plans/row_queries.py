"""Queries over vectors, labels and conversations: ranks, gates, pairs, samples, juries, evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveyard.functions import text as T
from sieveyard.functions.packs import ENGLISH
from sieveyard.operators import evaluation, gates, juries, preferences, problems, screen, vectors
from sieveyard.plans.corpus_queries import CONV, TERM, hits_sql, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def draw_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::bigint"


UNIT = """u as (select vec_id, label, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as u from embeddings)"""


def greedy_sql(threshold: float) -> str:
    return f"""with recursive {UNIT}, e as (select a.vec_id as i, b.vec_id as j from u a join u b on b.vec_id < a.vec_id where list_dot_product(a.u, b.u) > {threshold}),
o as (select vec_id, row_number() over (order by vec_id) as r from u),
g as (select 0::bigint as r, []::bigint[] as kept union all
  select o.r, case when exists (select 1 from e where e.i = o.vec_id and list_contains(g.kept, e.j)) then g.kept else list_append(g.kept, o.vec_id) end from g join o on o.r = g.r + 1),
k as (select unnest(kept) as vec_id from g where r = (select max(r) from o))
select vec_id, vec_id in (select vec_id from k) as kept from u"""


@query(greedy_sql(0.35))
def neardup_greedy_t035(spark, sf_dir):
    return vectors.greedy_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.35)


@query(greedy_sql(0.25))
def neardup_greedy_t025(spark, sf_dir):
    """At the usual threshold no vector of the tables goes, so lower ones stand in; planted copies are tested at 0.92."""
    return vectors.greedy_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.25)


SCORES = f"""{UNIT}, m as (select label < 5 as good, pos, avg(x) as x from (select label, unnest(u) as x, unnest(range(1, len(u) + 1)) as pos from u) group by all),
c as (select good, list(x order by pos) as c from m group by good), n as (select good, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) as c from c),
s as (select vec_id, label, list_dot_product(u, (select c from n where good)) - list_dot_product(u, (select c from n where not good)) as score from u)"""


def _scores(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.centroid_scores(v, v.where("label < 5"), v.where("label >= 5")).join(v.select("vec_id", "label"), "vec_id")


@query(f"with {SCORES} select vec_id, round(score, 4) as score, row_number() over (order by round(score, 4) desc, vec_id) as rank from s")
def centroid_rank(spark, sf_dir):
    s = _scores(spark, sf_dir).select("vec_id", F.round("score", 4).alias("score"), F.lit(1).alias("one"))
    ranked = preferences.running_total(s, [], [F.col("score").desc(), "vec_id"], "one", "rank", F.floor(-F.col("score") * 4096))
    return ranked.select("vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""with {SCORES} select round((avg(case when label < 5 then (score > 0)::int end) + avg(case when label >= 5 then (score <= 0)::int end)) / 2, 6) as balanced_accuracy,
round(quantile_disc(score, 0.5) filter (where label < 5), 6) as good_median, round(quantile_disc(score, 0.5) filter (where label >= 5), 6) as bad_median from s""")
def label_separation(spark, sf_dir):
    out = vectors.separation(_scores(spark, sf_dir), F.col("label") < 5)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"with {SCORES} select vec_id, round(score, 6) as score from s order by abs(score - 0.02), vec_id limit 40")
def boundary_40(spark, sf_dir):
    return vectors.boundary(_scores(spark, sf_dir), 0.02).select("vec_id", F.round("score", 6).alias("score"))


@query(f"with {SCORES} select count(*) as rows, count_if(score >= 0.02) as above, round(avg((score >= 0.02)::int), 6) as share from s")
def above_line(spark, sf_dir):
    out = vectors.above_share(_scores(spark, sf_dir), 0.02)
    return out.select("rows", "above", F.round("share", 6).alias("share"))


TOPK = f"""{UNIT}, q as (select * from u where vec_id % 100 = 0), r as (select q.vec_id as query_id, u.vec_id as passage_id, u.label as label, q.label as gold, list_dot_product(q.u, u.u) as score from q, u),
k as (select *, row_number() over (partition by query_id order by score desc, passage_id) as rank from r)"""


@query(f"with {TOPK} select query_id, cast(rank as int) as rank, passage_id, round(score, 6) as score from k where rank <= 5")
def dense_top5(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return vectors.top_passages(v.where("vec_id % 100 = 0"), v, k=5).select("query_id", "rank", "passage_id", F.round("score", 6).alias("score"))


@query(f"with {TOPK}, h as (select query_id, max((rank <= 1 and label = gold)::int) as a, max((label = gold)::int) as b from k where rank <= 5 group by query_id) select avg(a) as hit_1, avg(b) as hit_5 from h")
def retrieval_hits(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    ranked = vectors.top_passages(v.where("vec_id % 100 = 0"), v, k=5)
    label = v.select("vec_id", "label")
    hit = ranked.join(label.withColumnsRenamed({"vec_id": "passage_id", "label": "got"}), "passage_id").join(label.withColumnsRenamed({"vec_id": "query_id", "label": "gold"}), "query_id")
    return vectors.hit_rates(hit.select("query_id", "rank", (F.col("got") == F.col("gold")).alias("hit")))


@query("""with p as (select a.doc_id, a.text as gold, b.text as chunk from documents a join documents b on b.doc_id = a.doc_id + 1)
select doc_id, len(list_filter(range(0, greatest(length(gold) - 200, 1), 100), lambda i: contains(chunk, substr(gold, i + 1, 200)))) > 0 or contains(gold, substr(chunk, 1, 200)) as hit from p""")
def gold_overlap(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pairs = d.select("doc_id", F.col("text").alias("gold")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("chunk")), "doc_id")
    return pairs.select("doc_id", vectors.gold_overlap(F.col("chunk"), F.col("gold")).alias("hit"))


# gates over the first exchange of each conversation

CHOSEN = f"""{CONV}, i as (select conv_id, t, list_filter(range(1, len(t)), lambda i: t[i].role = 'user' and t[i + 1].role = 'assistant' and length(t[i + 1].text) > 150) as ix from c),
x as (select conv_id, t[ix[1]].text as prompt, t[ix[1] + 1].text as chosen from i where len(ix) > 0)"""


@query(f"""with {CHOSEN}, s as (select conv_id, prompt, chosen, (conv_id % 5) / 100.0 as score from x) select conv_id, md5(prompt) as prompt, md5(chosen) as chosen from s where score >= 0.02""")
def chosen_pool_scored(spark, sf_dir):
    convs = screen.conversations(table(spark, sf_dir, "conversations"))
    out = preferences.chosen_answers(convs, score=F.col("conv_id") % 5 / 100.0)
    return out.select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"), F.md5(F.col("chosen").cast("binary")).alias("chosen"))


@query("""select doc_id, doc_id % 4 <> 0 and doc_id % 4 <> 2 as passes from documents""")
def code_gate(spark, sf_dir):
    """Each text with a good block; every fourth has a second, broken one, and every fourth none at all."""
    good, bad = "```python\nx = 1\n```\n", "```python\nx = = 1\n```\n"
    kind = F.col("doc_id") % 4
    answer = F.concat(F.coalesce("text", F.lit("")), F.when(kind == 0, F.lit("\n" + good + bad)).when(kind == 2, F.lit("")).otherwise(F.lit("\n" + good)))
    return table(spark, sf_dir, "documents").select("doc_id", gates.code_block(answer, F.lit("python")).alias("passes"))


def _chosen(spark, sf_dir):
    return preferences.chosen_answers(screen.conversations(table(spark, sf_dir, "conversations")))


@query(f"with {CHOSEN} select conv_id, md5(prompt) as prompt, md5(chosen) as chosen from x")
def chosen_pool(spark, sf_dir):
    return _chosen(spark, sf_dir).select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"), F.md5(F.col("chosen").cast("binary")).alias("chosen"))


MD = r"'(?m)\*\*[^*]+\*\*|^\d+\.\s|^[-•] |^#{1,3} '"
SENTENCES = r"len(list_filter(regexp_split_to_array({0}, '[.!?…]+'), lambda s: regexp_replace(s, '[\s\p{{Z}}]+', '', 'g') <> ''))"


@query(f"""with {CHOSEN}, g as (select *, regexp_matches(chosen, {MD}) as md from x)
select conv_id, length(chosen) <= 260 and length(chosen) - length(replace(chosen, '.', '')) <= 3 and not md as short_answer, md as structured,
length(chosen) between 400 and 1100 and length(prompt) <= 140 and not md as chat, length(chosen) between 400 and 1200 and length(prompt) <= 160 and not md as chat_pro,
length(chosen) between 250 and 700 as refusal, length(chosen) between 250 and 800 as false_premise, length(prompt) >= 0.6 * length(chosen) and length(prompt) <= 1.4 * length(chosen) as edit_length,
length(prompt) <= 400 and {SENTENCES.format('prompt')} <= 4 and length(chosen) >= 2 * length(prompt) as short_padded, {SENTENCES.format('chosen')} between 2 and 12 as culture from g""")
def answer_gates(spark, sf_dir):
    u, a = F.col("prompt"), F.col("chosen")
    return _chosen(spark, sf_dir).select(
        "conv_id", gates.short_answer(a).alias("short_answer"), gates.structured(a).alias("structured"), gates.chat(u, a).alias("chat"), gates.chat(u, a, pro=True).alias("chat_pro"), gates.refusal(a).alias("refusal"),
        gates.false_premise(a).alias("false_premise"), gates.edit_length(u, a).alias("edit_length"), gates.short_padded(u, a).alias("short_padded"), gates.culture(a).alias("culture"),
    )


@query(f"""with {CONV} select conv_id, len(t) between 4 and 6 and len(list_filter(range(1, len(t) + 1), lambda i: t[i].role <> case when i % 2 = 1 then 'user' else 'assistant' end or length(t[i].text) < 5 or length(t[i].text) > 1400)) = 0 as ok from c""")
def multi_turn_shape(spark, sf_dir):
    return screen.conversations(table(spark, sf_dir, "conversations")).select("conv_id", gates.alternating(F.col("turns")).alias("ok"))


def clean_sql(x: str) -> str:
    return f"({hits_sql(x)} <= 2 and not regexp_matches(lower({x}), {TERM}))"


REJECTS = f"""{CHOSEN}, j as (select conv_id, case when not (length(prompt) > 0 and length(chosen) > 0) then 'parse' when not (length(chosen) between 200 and 1500) then 'length' when not {clean_sql('prompt')} then 'bleed' when not {clean_sql('chosen')} then 'bleed' end as reject from x)"""


@query(f"with {REJECTS} select coalesce(reject, 'ok') as reject, count(*) as n from j group by all")
def ordered_rejects(spark, sf_dir):
    u, a = F.col("prompt"), F.col("chosen")
    judged = gates.ordered_rejects(_chosen(spark, sf_dir), [
        ("parse", (F.length(u) > 0) & (F.length(a) > 0)), ("length", F.length(a).between(200, 1500)), ("bleed", gates.clean_language(u, ENGLISH)), ("bleed", gates.clean_language(a, ENGLISH)),
    ])
    return judged.groupBy(F.coalesce("reject", F.lit("ok")).alias("reject")).agg(F.count("*").alias("n"))


@query(f"with {CHOSEN} select conv_id, {clean_sql('prompt')} and {clean_sql('chosen')} and length(chosen) >= 200 as ok from x")
def sft_row_gate(spark, sf_dir):
    return _chosen(spark, sf_dir).select("conv_id", gates.sft_row(F.col("prompt"), F.col("chosen"), ENGLISH).alias("ok"))


@query(f"with {CHOSEN} select conv_id, array_to_string(list_filter([case when length(prompt) < 0.75 * length(chosen) then 'short' end, case when not {clean_sql('prompt')} then 'bleed' end], lambda x: x is not null), ',') as flags, trim(prompt) <> '' and prompt <> chosen and length(prompt) >= 80 as valid from x")
def rewrite_flags(spark, sf_dir):
    return _chosen(spark, sf_dir).select("conv_id", F.array_join(gates.depth_flags(F.col("prompt"), F.col("chosen"), ENGLISH), ",").alias("flags"), gates.rejected_valid(F.col("prompt"), F.col("chosen")).alias("valid"))


@query("select doc_id from (select doc_id, row_number() over (partition by lang, source order by doc_id) as r from documents) where r <= 8")
def variety_cap_8(spark, sf_dir):
    return gates.variety_cap(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], F.col("doc_id")).select("doc_id")


# pairs, samples, mixtures

SUBS = (("the ", "teh "), ("und", "unt"), ("que", "ke"), ("and", "an"), ("ich", "isch"))


def _bleed_sql() -> str:
    keys = ", ".join(f"case when contains(lower(chosen), '{a}') then {draw_sql('7', 'conv_id', str(i))} end as k{i}" for i, (a, _) in enumerate(SUBS))
    out = "chosen"
    for i, (a, b) in enumerate(SUBS):
        out = rf"case when list_contains(r, k{i}) then regexp_replace({out}, '(?si)^(.*?){a}', '\1{b}') else {out} end"
    return f"with {CHOSEN}, k as (select *, {keys} from x), r as (select *, list_sort(list_filter([{', '.join(f'k{i}' for i in range(len(SUBS)))}], lambda v: v is not null))[1:3] as r from k) select conv_id, case when {out} <> chosen then md5({out}) end as rejected from r"


@query(_bleed_sql())
def bleed_rejected(spark, sf_dir):
    out = preferences.bleed_rejected(_chosen(spark, sf_dir), SUBS, seed=7)
    return out.select("conv_id", F.md5(F.col("rejected").cast("binary")).alias("rejected"))


@query(f"with {CHOSEN}, o as (select conv_id, row_number() over (order by md5('20260727:' || conv_id), conv_id) as pos from x) select conv_id, cast(pos as int) as pos, case when pos <= 33 then 'roundtrip' when pos <= 55 then 'bloat' else 'bleed' end as kind from o where pos <= 70 and conv_id % 5 <> 0")
def quota_kinds_70(spark, sf_dir):
    done = table(spark, sf_dir, "conversations").where("conv_id % 5 = 0").select("conv_id").distinct()
    return preferences.quota_kinds(_chosen(spark, sf_dir), (("roundtrip", 33), ("bloat", 22), ("bleed", 15)), done=done)


@query("select doc_id from documents order by md5('42:' || doc_id), doc_id limit 100")
def seeded_sample_100(spark, sf_dir):
    return preferences.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), 100)


@query("select doc_id, case when row_number() over (order by md5('20260727:' || doc_id), doc_id) <= 500 then 'holdout' else 'train' end as split from documents")
def frozen_split_500(spark, sf_dir):
    return preferences.frozen_split(table(spark, sf_dir, "documents").select("doc_id"))


@query("with o as (select doc_id, row_number() over (order by md5('20260727:' || doc_id), doc_id) <= 500 as held from documents) select count(*) as leaks from o a join o b on a.doc_id = b.doc_id where a.held and not b.held")
def holdout_leaks(spark, sf_dir):
    split = preferences.frozen_split(table(spark, sf_dir, "documents").select("doc_id"))
    return preferences.assert_disjoint(split.where("split = 'train'"), split.where("split = 'holdout'"), "doc_id").agg(F.count("*").alias("leaks"))


@query(f"select doc_id, case when {draw_sql('5', 'doc_id')} / 4294967296.0 < 0.55 then 'a' when {draw_sql('5', 'doc_id')} / 4294967296.0 < 0.8 then 'b' else 'c' end as choice from documents")
def weighted_choice(spark, sf_dir):
    return preferences.weighted_choice(table(spark, sf_dir, "documents").select("doc_id"), [("a", 0.55), ("b", 0.25), ("c", 0.20)], seed=5)


@query(f"with {CONV} select conv_id from c where len(t) = 2 and length(t[2].text) between 600 and 1200 order by conv_id limit 3")
def anchors_3(spark, sf_dir):
    return preferences.anchors(screen.conversations(table(spark, sf_dir, "conversations")))


TOKENS = r"len(list_filter(regexp_split_to_array(text, '[\s\p{Z}]+'), lambda x: x <> ''))"


def _sized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce(F.size(T.tokens("text")), F.lit(0)).cast("long").alias("n_tokens"))


@query(f"""with s as (select doc_id, source, {TOKENS} as n from documents), q as (select * from (values ('src0', 0.65), ('src1', 0.2), ('src2', 0.1), ('src3', 0.05)) t(source, share)),
r as (select doc_id, source, n, share, sum(n) over (partition by source order by doc_id) as upto from s join q using (source)) select doc_id, source, cast(upto as bigint) as upto from r where upto <= share * 40000""")
def token_mixture_40k(spark, sf_dir):
    return preferences.token_mixture(_sized(spark, sf_dir), [("src0", 0.65), ("src1", 0.2), ("src2", 0.1), ("src3", 0.05)], 40000).select("doc_id", "source", "upto")


@query("select doc_id, unnest(case when lang = 'en' then [1] else [1, 2, 3] end) as copy from documents")
def oversample_3(spark, sf_dir):
    return preferences.oversample(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.coalesce(F.col("lang") != "en", F.lit(True))).select("doc_id", "copy")


@query(f"""with s as (select lang as shard, doc_id, {TOKENS} + 1 as n from documents), p as (select *, sum(n) over (partition by shard order by doc_id) - n as start, sum(n) over (partition by shard order by doc_id) as stop, sum(n) over (partition by shard) // 512 as blocks from s),
b as (select *, unnest(range((start // 512)::bigint, ((stop - 1) // 512 + 1)::bigint)) as block from p)
select shard, block, doc_id, cast(greatest(start, block * 512) - block * 512 as bigint) as at, cast(least(stop, (block + 1) * 512) - greatest(start, block * 512) as bigint) as length from b where block < blocks""")
def packed_blocks_512(spark, sf_dir):
    return preferences.packed_blocks(_sized(spark, sf_dir), 512, F.col("lang"))


# juries: votes derived from digests

VOTES = f"votes as (select doc_id as id, j, {draw_sql('doc_id', 'j')} % 4 as v, {draw_sql(chr(39) + 'key' + chr(39), 'doc_id')} % 4 as key from labels, (values (1), (2), (3)) t(j))"


def _votes(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.explode(F.array(*[F.lit(j) for j in (1, 2, 3)])).alias("j"))
    return rows.select("id", "j", (T.draw("id", "j") % 4).alias("v"), (T.draw(F.lit("key"), "id") % 4).alias("key"))


@query(f"with {VOTES}, c as (select id, count_if(v = 1) as yes, count_if(v <> 3) as valid from votes group by id) select id, yes, valid, yes >= 2 or (valid = 1 and yes = 1) as kept from c")
def entailment_panel(spark, sf_dir):
    return juries.entailment_panel(_votes(spark, sf_dir).select("id", F.when(F.col("v") != 3, F.col("v") == 1).alias("vote")))


@query(f"with {VOTES}, c as (select id, count_if(v <> 3 and v = key) as agree, count_if(v <> 3) as valid from votes group by id) select id, agree, valid, case when valid < 2 then 'unresolved' when agree >= 2 then 'kept' else 'dropped' end as outcome from c")
def cold_answer_panel(spark, sf_dir):
    return juries.cold_panel(_votes(spark, sf_dir).select("id", "key", F.when(F.col("v") != 3, F.col("v")).alias("vote")))


@query(ORACLES["cold_answer_panel"].replace("select id, agree", "select count_if(outcome = 'unresolved') as unresolved, count_if(outcome <> 'unresolved') as resolved, count_if(outcome = 'unresolved') > 50 and count_if(outcome = 'unresolved') > 3 * count_if(outcome <> 'unresolved') as abort from (select id, agree") + ")")
def panel_health(spark, sf_dir):
    return juries.panel_health(cold_answer_panel(spark, sf_dir))


@query("select doc_id as id from labels where quality = 1 and doc_id not in (select doc_id from labels where toxic = 1) and doc_id not in (select doc_id from documents where lang = 'de')")
def resume_antijoin(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    german = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("id"))
    return juries.still_to_do(labels.where("quality = 1"), labels.where("toxic = 1"), german).select("id")


# evaluations: models and answers derived from the tables

ANSWERS = "answers as (select item_id as qid, m as model, case m when 'a' then text else reverse(text) end as answer from benchmark, (values ('a'), ('b')) t(m))"


def _answers(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), "text").select("qid", "model", F.when(F.col("model") == "a", F.col("text")).otherwise(F.reverse("text")).alias("answer"))


KEY = f"key as (select item_id as qid, case when {draw_sql('7', 'item_id')} % 2 = 1 then 'b' else 'a' end as model from benchmark)"


@query(f"with {KEY} select qid, model, md5(case model when 'a' then text else reverse(text) end) as ans_1, md5(case model when 'a' then reverse(text) else text end) as ans_2 from key join benchmark on item_id = qid")
def blind_pairs(spark, sf_dir):
    pairs, key = evaluation.blind_pairs(_answers(spark, sf_dir), "a", "b")
    return pairs.join(key, "qid").select("qid", "model", F.md5(F.col("ans_1").cast("binary")).alias("ans_1"), F.md5(F.col("ans_2").cast("binary")).alias("ans_2"))


@query(f"""with {KEY}, w as (select qid % 4 as category, case when v = 0 then 'tie' when v = 1 then model when model = 'a' then 'b' else 'a' end as winner from (select qid, model, {draw_sql("'vote'", 'qid')} % 3 as v from key))
select category, count_if(winner = 'a') as first, count_if(winner = 'b') as second, count_if(winner = 'tie') as ties from w group by rollup (category)""")
def unsealed_tally(spark, sf_dir):
    _, key = evaluation.blind_pairs(_answers(spark, sf_dir), "a", "b")
    votes = key.select("qid", (T.draw(F.lit("vote"), "qid") % 3).alias("vote"))
    return evaluation.unseal(votes, key, key.select("qid", (F.col("qid") % 4).alias("category")), ("a", "b"))


@query("with a as (select distinct lang as qid, source as model from documents) select x.qid, x.model as model_a, y.model as model_b from a x join a y on x.qid = y.qid and x.model < y.model")
def arena_matchups(spark, sf_dir):
    return evaluation.matchups(table(spark, sf_dir, "documents").select(F.col("lang").alias("qid"), F.col("source").alias("model")).distinct())


@query(f"""with v as (select 'm' || {draw_sql("'a'", 'doc_id')} % 5 as a, 'n' || {draw_sql("'b'", 'doc_id')} % 5 as b, {draw_sql("'w'", 'doc_id')} % 4 as w from documents),
e as (select a as model, w = 0 as won, w = 2 as tied from v where w <> 3 union all select b, w = 1, w = 2 from v where w <> 3)
select model, count_if(won) as wins, count_if(tied) as ties, count(*) as games, round((count_if(won) + 0.5 * count_if(tied)) / count(*), 6) as score from e group by model""")
def arena_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = lambda p, k: F.concat(F.lit(p), (T.draw(F.lit(k), "doc_id") % 5).cast("string"))
    votes = d.select(name("m", "a").alias("model_a"), name("n", "b").alias("model_b"), F.element_at(F.array(*map(F.lit, ("a", "b", "tie", "skip"))), (T.draw(F.lit("w"), "doc_id") % 4 + 1).cast("int")).alias("winner"))
    return evaluation.arena(votes).withColumn("score", F.round("score", 6))


CHOICES = f"""s as (select lang as task, doc_id as item, c as choice, -({draw_sql('doc_id', 'c')} % 1000) - 1.0 as loglik, 5 + {draw_sql('doc_id', 'c', "'n'")} % 40 as n_chars, {draw_sql('doc_id', "'gold'")} % 4 as gold from documents, (values (0), (1), (2), (3)) t(c))"""


def _choices(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("task"), F.col("doc_id").alias("item"), F.explode(F.array(*[F.lit(c) for c in range(4)])).alias("choice"))
    return rows.select("task", "item", "choice", (-(T.draw("item", "choice") % 1000) - 1.0).alias("loglik"), (T.draw("item", "choice", F.lit("n")) % 40 + 5).alias("n_chars"), (T.draw("item", F.lit("gold")) % 4).alias("gold"))


ACC = f"""{CHOICES}, b as (select task, item, gold, arg_max(choice, loglik * 10 - choice * 0.001) as x, arg_max(choice, loglik / n_chars - choice * 1e-9) as y from s group by all),
r as (select task, avg((x = gold)::int) as acc, stddev_samp((x = gold)::int) / sqrt(count(*)) as acc_stderr, avg((y = gold)::int) as acc_norm, stddev_samp((y = gold)::int) / sqrt(count(*)) as acc_norm_stderr from b group by task)"""


@query(f"with {ACC} select task, round(acc, 6) as acc, round(acc_stderr, 6) as acc_stderr, round(acc_norm, 6) as acc_norm, round(acc_norm_stderr, 6) as acc_norm_stderr from r")
def choice_accuracy(spark, sf_dir):
    out = evaluation.choice_accuracy(_choices(spark, sf_dir))
    return out.select("task", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _results(spark, sf_dir):
    acc = evaluation.choice_accuracy(_choices(spark, sf_dir))
    return acc.select(F.lit("sum").alias("model"), "task", "acc", F.col("acc_stderr").alias("stderr")).unionByName(acc.select(F.lit("mean").alias("model"), "task", F.col("acc_norm").alias("acc"), F.col("acc_norm_stderr").alias("stderr")))


RESULTS = f"{ACC}, t as (select 'sum' as model, task, acc, acc_stderr as stderr from r union all select 'mean', task, acc_norm, acc_norm_stderr from r), a as (select model, avg(acc) as average, sqrt(sum(stderr * stderr)) / count(*) as se from t group by model)"


@query(f"with {RESULTS} select model, round(average, 6) as average, round(se, 6) as se from a")
def suite_averages(spark, sf_dir):
    return evaluation.suite_average(_results(spark, sf_dir)).select("model", F.round("average", 6).alias("average"), F.round("se", 6).alias("se"))


@query(f"with {RESULTS} select round((x.average - y.average) / sqrt(x.se * x.se + y.se * y.se), 5) as z from a x, a y where x.model = 'sum' and y.model = 'mean'")
def suite_z(spark, sf_dir):
    return evaluation.z_score(evaluation.suite_average(_results(spark, sf_dir)), "sum", "mean").select(F.round("z", 5).alias("z"))


@query(f"with {RESULTS} select round(avg(acc) filter (where model = 'sum' and task in ('de', 'fr')) - avg(acc) filter (where model = 'mean' and task in ('de', 'fr')), 6) as inside, round(avg(acc) filter (where model = 'sum' and task not in ('de', 'fr')) - avg(acc) filter (where model = 'mean' and task not in ('de', 'fr')), 6) as outside from t")
def subset_margins(spark, sf_dir):
    out = evaluation.subset_margin(_results(spark, sf_dir), ["de", "fr"], "sum", "mean")
    return out.select(F.round("inside", 6).alias("inside"), F.round("outside", 6).alias("outside"))


@query(f"with {CHOICES}, b as (select item, arg_max(choice, loglik / n_chars - choice * 1e-9) as y from s group by item) select count(*) as items, round(avg((y = 0)::int), 6) as accuracy from b")
def fact_probe(spark, sf_dir):
    out = evaluation.fact_probe(_choices(spark, sf_dir).select("item", "choice", F.col("loglik").alias("total"), F.col("n_chars").alias("tokens")))
    return out.select("items", F.round("accuracy", 6).alias("accuracy"))


@query(f"""with {CHOICES}, p as (select item, max(task) as kind, max(loglik) filter (where choice = 0) as c, max(loglik) filter (where choice = 1) as r, max(n_chars) filter (where choice = 0) as cn, max(n_chars) filter (where choice = 1) as rn from s group by item)
select kind, count(*) as n, round(avg((c > r)::int), 6) as by_sum, round(avg((c / cn > r / rn)::int), 6) as by_mean from p group by rollup (kind)""")
def preference_accuracy(spark, sf_dir):
    s = _choices(spark, sf_dir).where("choice < 2")
    pairs = s.groupBy("item").agg(F.max("task").alias("kind"), *[F.max(F.when(F.col("choice") == k, F.col(c))).alias(n) for k, c, n in ((0, "loglik", "chosen_sum"), (1, "loglik", "rejected_sum"), (0, "n_chars", "chosen_n"), (1, "n_chars", "rejected_n"))])
    return evaluation.preference_accuracy(pairs).select("kind", "n", F.round("by_sum", 6).alias("by_sum"), F.round("by_mean", 6).alias("by_mean"))


@query(r"""with e as (select doc_id, cast(doc_id % 20 as varchar) as number, regexp_replace(text, '[.,\s\p{Z}]', '', 'g') as t from documents)
select count(*) as items, count_if(regexp_matches(t, '(^|[^0-9])' || number || '([^0-9]|$)')) as right from e""")
def math_probe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("text").alias("answer"), F.array((F.col("doc_id") % 20).cast("string")).alias("expected"))
    return evaluation.math_probe(rows)


@query("""with a as (select case when nullif(regexp_extract(upper(text), '[ABCD]'), '') is not null then instr('ABCD', regexp_extract(upper(text), '[ABCD]')) - 1 end as p, doc_id % 4 as g from documents)
select count(*) as n, count(p) as answered, count_if(p = g) as correct, round(avg((p = g)::int), 6) as acc from a""")
def generative_accuracy(spark, sf_dir):
    out = evaluation.generative_accuracy(table(spark, sf_dir, "documents"), T.answer_index("text", "ABCD"), F.col("doc_id") % 4)
    return out.select("n", "answered", "correct", F.round("acc", 6).alias("acc"))


@query(rf"""select lang, cast(sum(len(regexp_extract_all(text, '\p{{L}}{{1,4}}|\p{{N}}|[^\s\p{{L}}\p{{N}}]'))) as bigint) as tokens, cast(sum({TOKENS}) as bigint) as words, round(sum(len(regexp_extract_all(text, '\p{{L}}{{1,4}}|\p{{N}}|[^\s\p{{L}}\p{{N}}]'))) / sum({TOKENS}), 6) as fertility,
sum(len(regexp_extract_all(text, '\p{{L}}{{1,4}}|\p{{N}}|[^\s\p{{L}}\p{{N}}]'))) / sum({TOKENS}) > 2.7 * 1.3 as warns from documents group by lang""")
def tokenizer_fertility(spark, sf_dir):
    """Of a tokenizer that cuts words into runs of four letters; any count of tokens can take its place."""
    docs = table(spark, sf_dir, "documents")
    out = evaluation.fertility(docs, F.regexp_count("text", F.lit(r"\p{L}{1,4}|\p{N}|[^\s\p{L}\p{N}]")), ["lang"])
    return out.select("lang", "tokens", "words", F.round("fertility", 6).alias("fertility"), "warns")


@query("select distinct doc_id as id from labels where doc_id not in (select doc_id from labels where quality = 0)")
def review_labels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    return evaluation.good_ids(labels, labels.where("quality = 0"))


@query(rf"""with {CONV}, r as (select conv_id, list_filter(t, lambda x: x.role = 'system') as s, list_filter(t, lambda x: x.role <> 'system') as r from c)
select conv_id, md5(array_to_string(list_transform(range(1, len(r) + 1), lambda i: case when r[i].role = 'assistant' then '<|turn>model' || chr(10) else '<|turn>user' || chr(10) end || case when i = 1 and len(s) > 0 then array_to_string(list_transform(s, lambda x: x.text), chr(10)) || chr(10) || chr(10) else '' end || r[i].text || '<turn|>' || chr(10)), '')) as digest from r""")
def rendered_chats(spark, sf_dir):
    c = screen.conversations(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", F.md5(evaluation.render_chat(F.col("turns")).cast("binary")).alias("digest"))


@query("""with i as (select item_id, text, string_split(text, ' ') as w from benchmark)
select item_id, trim(text) as question, cast(instr('ABCDE', chr(65 + item_id::int % 7)) - 1 as int) as gold, instr('ABCDE', chr(65 + item_id::int % 7)) > 0 and len(w[1:3]) >= 2 and instr('ABCDE', chr(65 + item_id::int % 7)) - 1 < len(w[1:3]) as ok,
regexp_replace(text, '\\.+$', '') || ', ' || case when item_id % 2 = 0 then 'because' else 'so' end as copa from i""".replace("\\\\", "\\"))
def benchmark_items(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    choices = F.slice(F.split("text", " "), 1, 3)
    item, ok = evaluation.exams_item(F.col("text"), choices, F.char(F.lit(65) + F.col("item_id").cast("int") % 7))
    copa = evaluation.copa_item(F.col("text"), F.col("item_id") % 2 == 0, choices[0], choices[1], F.lit(0), "because", "so")
    return b.select("item_id", item["question"].alias("question"), item["gold"].alias("gold"), ok.alias("ok"), copa["question"].alias("copa"))


@query("""select item_id, 'Question: ' || text || chr(10) || array_to_string(list_transform(range(1, len(string_split(text, ' ')[1:4]) + 1), lambda i: chr((64 + i)::int) || '. ' || string_split(text, ' ')[i]), chr(10)) || chr(10) || 'Answer:' as prompt from benchmark""")
def choice_prompts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", evaluation.choice_prompt(F.col("text"), F.slice(F.split("text", " "), 1, 4), "Question: ", "\nAnswer:").alias("prompt"))


@query(rf"""with {CHOSEN}, g as (select conv_id, prompt, chosen, conv_id % 7 - 1 as answer, string_split(prompt, ' ')[1:3 + conv_id % 2] as choices, case when conv_id % 3 = 0 then 'nicht ' else '' end as inside from x)
select conv_id, {clean_sql('chosen')} as prose, case when inside = '' then {clean_sql('chosen')} else {clean_sql("'nicht '")} end as prose_marked, len(choices) = 4 and answer between 0 and 3 as choice_shape,
contains(replace(chosen, ',', '.'), cast(conv_id % 30 as varchar)) as answer_present from g""")
def generated_row_gates(spark, sf_dir):
    """Every third answer also has a foreign word: within a fence, where it does not count, and before the text, where it does."""
    a, word = F.col("chosen"), F.when(F.col("conv_id") % 3 == 0, "nicht ").otherwise("")
    fenced = F.concat(a, F.lit("\n```python\n# "), word, F.lit("\n```"))
    choices = F.slice(F.split("prompt", " "), F.lit(1), (F.lit(3) + F.col("conv_id") % 2).cast("int"))
    return _chosen(spark, sf_dir).select(
        "conv_id", gates.clean_language(fenced, ENGLISH, code=True).alias("prose"), gates.clean_language(F.concat(word, a), ENGLISH).alias("prose_marked"),
        gates.choice_shape(choices, F.col("conv_id") % 7 - 1).alias("choice_shape"), gates.answer_present(a, (F.col("conv_id") % 30).cast("string")).alias("answer_present"),
    )


@query(f"""with w as (select doc_id, string_split(text, ' ')[1:6 + doc_id % 7] as v from documents where text is not null), k as (select doc_id, len(v) as n, array_to_string(v[1:10], ' ') as kept from w)
select doc_id, n >= 8 and {clean_sql('kept')} as ok, md5(kept) as kept from k""")
def paraphrase_packs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    ok, kept = gates.paraphrases(F.slice(F.split("text", " "), F.lit(1), (F.lit(6) + F.col("doc_id") % 7).cast("int")), ENGLISH)
    return docs.select("doc_id", ok.alias("ok"), F.md5(F.array_join(kept, " ").cast("binary")).alias("kept"))


@query("""with r as (select item_id, item_id % 3 as k, regexp_replace(text, '[{}`<>]', ' ', 'g') as t from benchmark)
select item_id, case when k > 0 then '{"id": ' || item_id || ', "of": {"k": ' || k || '}}' end as json, md5(trim(t)) as answer,
case when item_id % 8 = 0 then cast(item_id // 8 as varchar) else regexp_replace(printf('%.2f', item_id / 8 + 0.001), '0$', '') end as number from r""")
def reply_fields(spark, sf_dir):
    """Replies made of the items: JSON with or without fences, thoughts before and a turn's end behind the answer, eighths as numbers."""
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 3).alias("k"), F.regexp_replace("text", "[{}`<>]", " ").alias("t"))
    body = F.concat(F.lit('{"id": '), F.col("item_id").cast("string"), F.lit(', "of": {"k": '), F.col("k").cast("string"), F.lit("}}"))
    reply = F.concat("t", F.when(F.col("k") == 0, "").when(F.col("k") == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit(" so "), body, F.lit("."))), F.lit(" end"))
    answer = F.concat(F.lit("<think>why</think> "), "t", F.lit(" <end_of_turn> user again"))
    number = F.when(F.col("item_id") % 8 == 0, F.col("item_id") / 8).otherwise(F.col("item_id") / 8 + 0.001)
    return b.select("item_id", T.json_object(reply).alias("json"), F.md5(T.clean_answer(answer).cast("binary")).alias("answer"), T.number_text(number).alias("number"))


@query("""with i as (select item_id, trim(text) as question, list_filter(string_split(text, ' ')[1:4], lambda x: x <> '' and length(x) <> 5) as choices, item_id % 5 as gold from benchmark)
select item_id, question, array_to_string(choices, '|') as choices, cast(gold as int) as gold, gold < len(choices) as ok from i""")
def include_items(spark, sf_dir):
    """Options of five letters are blanked; answers come as number or letter by turns."""
    b, w = table(spark, sf_dir, "benchmark"), F.split("text", " ")
    options = [F.when(F.length(F.get(w, F.lit(i))) == 5, "").otherwise(F.get(w, F.lit(i))) for i in range(4)]
    place = (F.col("item_id") % 5).cast("int")
    answer = F.when(F.col("item_id") % 2 == 0, place.cast("string")).otherwise(F.lower(F.char(place + 65)))
    item, ok = evaluation.include_item(F.col("text"), options, answer, letters="ABCDE")
    return b.select("item_id", item["question"].alias("question"), F.array_join(item["choices"], "|").alias("choices"), item["gold"].alias("gold"), ok.alias("ok"))


@query("""with v as (select item_id, string_split(text, ' ')[1:3] as claims, string_split(text, ' ')[1:3 - (item_id % 4 = 1)::int] as judged from benchmark)
select item_id, case when item_id % 4 <> 0 then len(judged) = len(claims) and len(list_filter(judged, lambda x: length(x) < 2)) = 0 and item_id % 6 <> 5 end as vote from v""")
def entailment_votes(spark, sf_dir):
    """A claim for each of three words, supported if it has two letters; every fourth panel is silent, another is short of a verdict."""
    b = table(spark, sf_dir, "benchmark")
    claims = F.slice(F.split("text", " "), 1, 3)
    judged = F.slice(F.split("text", " "), F.lit(1), F.when(F.col("item_id") % 4 == 1, 2).otherwise(3))
    verdicts = F.when(F.col("item_id") % 4 != 0, F.transform(judged, lambda w: F.length(w) >= 2))
    return b.select("item_id", juries.entails(verdicts, claims, F.col("item_id") % 6 != 5).alias("vote"))


@query()
def math_problems_1000(spark, sf_dir):
    return problems.problems(spark, 1000)
