"""Queries over documents and conversations: screens, models, leaks, funnels."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveyard.functions import text as T
from sieveyard.functions.packs import ENGLISH
from sieveyard.operators import decontaminate, languages, lookup, preferences, screen, vectors
from sieveyard.sources.staging import stage

W = r"[\p{L}\p{N}_]+"
FOREIGN = ENGLISH.foreign
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HITS = rf"""
  select doc_id, source, text, n_chars,
    len(regexp_extract_all(lower(text), '{FOREIGN}')) as f,
    len(list_filter(regexp_extract_all(lower(text), '{W}'), lambda w: regexp_matches(w, '[a-z]') and regexp_matches(w, '[0-9]'))) as h,
    len(list_filter(regexp_extract_all(text, '{W}'), lambda w: regexp_matches(w, '^[Qq]q'))) as d,
    coalesce(regexp_matches(lower(text), 'nicht|avec|cuando|wasser'), false) as t
  from documents
"""


@query(f"select doc_id, cast(coalesce(f + h + d, 0) as bigint) as hits, t as term, case when coalesce(f + h + d, 0) > 2 then 'script' when t then 'term' end as reason from ({HITS})")
def bleed_filter_en(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", screen.script_hits("text", ENGLISH).cast("long").alias("hits"), screen.has_term("text", ENGLISH).alias("term"), screen.bleed_reason("text", ENGLISH).alias("reason"))


@query(f"select source, coalesce(reason, 'kept') as reason, count(*) as n, sum(n_chars) as chars from (select source, n_chars, case when coalesce(f + h + d, 0) > 2 then 'script' when t then 'term' end as reason from ({HITS})) group by all")
def bleed_by_source_en(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "n_chars", F.coalesce(screen.bleed_reason("text", ENGLISH), F.lit("kept")).alias("reason"))
    return docs.groupBy("source", "reason").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""select count(*) as docs, count_if(f > 0) as docs_with_any_foreign_letter, count_if(f > 2) as reject_letters, count_if(h > 2) as reject_homoglyph,
  count_if(d > 0) as hit_digraph, count_if(t) as reject_blocklist, count_if(f + h + d > 2 or t) as rejected_total from ({HITS}) where text is not null""")
def character_census_en(spark, sf_dir):
    return screen.census(table(spark, sf_dir, "documents"), ENGLISH)


@query(f"select letter, count(distinct doc_id) as docs, count(*) as hits from (select doc_id, unnest(regexp_extract_all(lower(text), '{FOREIGN}')) as letter from documents) group by letter")
def letter_census_en(spark, sf_dir):
    return screen.letter_census(table(spark, sf_dir, "documents"), ENGLISH)


@query(rf"""with m as (select list_filter(regexp_extract_all(lower(text), '{W}'), lambda w: regexp_matches(w, '[a-z]') and regexp_matches(w, '[éèêçñóíäöüß]')) as m from documents)
select word, count(*) as n from (select unnest(m) as word from m where len(m) > 2) group by word order by n desc, word limit 12""")
def mixed_words_top12(spark, sf_dir):
    """Of a pack for which letters with accents are the other script."""
    return screen.top_mixed(table(spark, sf_dir, "documents"), replace(ENGLISH, other=FOREIGN))


@query(" union all ".join(f"select '{t}' as term, count(*) as docs from documents where contains(lower(text), '{t}') having count(*) > 0" for t in ENGLISH.terms))
def bleed_term_documents(spark, sf_dir):
    return screen.term_documents(table(spark, sf_dir, "documents"), ENGLISH)


@query("select doc_id, case when lang = 'en' then 32000.0::double else 3595.0::double end as most from documents")
def perplexity_threshold_by_register(spark, sf_dir):
    register = F.when(F.col("lang") == "en", "conversation").otherwise("prose")
    return table(spark, sf_dir, "documents").select("doc_id", languages.perplexity_threshold(register).alias("most"))


@query(rf"""with e as (select doc_id, unnest(list_filter(regexp_extract_all(lower(text), '{W}'), lambda w: regexp_matches(w, '{FOREIGN}'))) as word from documents),
c as (select word, count(*) as n, count(distinct doc_id) as docs, min(doc_id) as first_doc from e group by word order by n desc, first_doc, word limit 300)
select word, n, docs, first_doc, substr(text, greatest(instr(lower(text), word) - 40, 1), length(word) + 80) as context from c join documents on doc_id = first_doc""")
def bleed_draft_top300(spark, sf_dir):
    return screen.draft_terms(table(spark, sf_dir, "documents"), ENGLISH)


def _languages(spark, sf_dir, rows=None):
    """Of all documents, or of other rows by their profile."""
    docs = table(spark, sf_dir, "documents")
    return languages.language_confidence(docs if rows is None else rows, languages.language_profile(docs))


@query(rf"""with clean as (select doc_id, lang, regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g') as c from documents),
g as (select doc_id, lang, unnest(list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3))) as gram from clean where length(c) >= 3),
n as (select lang, gram, count(*) as n from g where lang is not null group by all),
k as (select gram from n group by gram having sum(n) >= 20),
l as (select lang, sum(n) as total from n join k using (gram) group by lang),
p as (select k.gram, l.lang, ln((coalesce(n.n, 0) + 1) / (l.total + (select count(*) from k))) as weight from k cross join l left join n on n.gram = k.gram and n.lang = l.lang),
s as (select doc_id, p.lang, sum(c.n * weight) / sum(c.n) as mean from (select doc_id, gram, count(*) as n from g group by all) c join p using (gram) group by all),
b as (select doc_id, max(mean) as top, arg_max(lang, mean) as label from s group by doc_id)
select s.doc_id, label, round(1 / sum(exp(50 * (mean - top))), 6) as conf from s join b using (doc_id) group by s.doc_id, label""")
def trigram_language(spark, sf_dir):
    return _languages(spark, sf_dir).select("doc_id", "label", F.round("conf", 6).alias("conf"))


@query(ORACLES["trigram_language"].replace("select s.doc_id, label, round(1 / sum(exp(50 * (mean - top))), 6) as conf from s", "select s.doc_id from s") + " having label = 'en' and 1 / sum(exp(50 * (mean - top))) > 0.65")
def language_filter_en(spark, sf_dir):
    return languages.language_filter(_languages(spark, sf_dir), "en", 0.65).select("doc_id")


NORMAL_WORDS = r"""list_concat(['<s>'], list_concat(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '([^\p{L}\p{N}\s])', ' \1 ', 'g'), '[\s\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> ''), ['</s>']))"""
PAIRS = f"""w as (select doc_id, {NORMAL_WORDS} as w from documents where text is not null),
p as (select doc_id, w1, w2, count(*) as n from (select doc_id, w[i] as w1, w[i + 1] as w2 from (select doc_id, w, unnest(range(1, len(w))) as i from w)) group by all),
h as (select doc_id, ('0x' || substr(md5(cast(doc_id as varchar)), 1, 8))::bigint % 50 = 0 as held_out from documents),
c as (select w1, w2, sum(n) as n from p join h using (doc_id) where not held_out group by all),
b as (select w1, sum(n) as total, count(*) as kinds from c group by w1),
a as (select w2, count(*) as contexts from c group by w2),
pc as (select w2, (contexts + 0.5) / ((select sum(contexts) from a) + 0.5 * ((select count(*) from a) + 1)) as pc from a),
m as (select c.w1, c.w2, log10((c.n - 0.75) / b.total + 0.75 * kinds / b.total * pc) as logp from c join b using (w1) join pc using (w2)),
s as (select p.doc_id, sum(p.n * coalesce(m.logp, log10(coalesce(0.75 * b.kinds / b.total, 1.0) * coalesce(pc.pc, (select min(pc) from pc) / 2)))) as score, sum(p.n) - 1 as words
  from p left join m on m.w1 = p.w1 and m.w2 = p.w2 left join b on b.w1 = p.w1 left join pc on pc.w2 = p.w2 group by p.doc_id)"""


def kneser_ney_sql(order: int) -> str:
    """Interpolated Kneser-Ney by lists: the probability of each kind of gram, from its last word outwards."""
    levels, steps = [f"t{order} as (select g, n from seen where len(g) = {order})"], []
    for k in range(order - 1, 0, -1):
        levels.append(f"t{k} as (select g, n from seen where len(g) = {k} union all select g[2:] as g, count(*) as n from t{k + 1} group by 1)")
    for k in range(2, order + 1):
        levels.append(f"x{k} as (select g[:{k - 1}] as x, sum(n) as total, count(*) as kinds from t{k} group by 1)")
        steps.append(f"""s{k} as (select s.g, case when len(s.g) < {k} or total is null then p else greatest(coalesce(n, 0) - 0.75, 0) / total + 0.75 * kinds / total * p end as p
  from (select *, case when len(g) >= {k} then g[-{k}:] end as tail from s{k - 1}) s left join t{k} on t{k}.g = tail left join x{k} on x = tail[:{k - 1}])""")
    return f"""forms as (select doc_id, ('0x' || substr(md5(cast(doc_id as varchar)), 1, 8))::bigint % 50 = 0 as held_out, {NORMAL_WORDS} as w from documents where text is not null),
e as (select doc_id, held_out, unnest(list_transform(range(2, len(w) + 1), lambda i: w[greatest(i - {order - 1}, 1):i])) as g from forms),
seen as (select g, count(*) as n from e where not held_out group by g), {', '.join(levels)},
pc as (select g, (n + 0.5) / ((select sum(n) from t1) + 0.5 * ((select count(*) from t1) + 1)) as p from t1),
s1 as (select a.g, coalesce(pc.p, (select min(p) from pc) / 2) as p from (select distinct g from e) a left join pc on pc.g = a.g[-1:]), {', '.join(steps)},
v as (select doc_id, held_out, pow(10, -sum(log10(p)) / greatest(count(*) - 1, 1)) as ppl from e join s{order} using (g) group by all)"""


def _perplexities(spark, sf_dir, order):
    forms = languages.normal_forms(table(spark, sf_dir, "documents"))
    return languages.perplexity(forms, languages.perplexity_model(forms, order), order)


@query(f"with {kneser_ney_sql(5)} select doc_id, round(ppl, 4) as ppl, held_out from v")
def kneser_ney_perplexity_5(spark, sf_dir):
    return _perplexities(spark, sf_dir, 5).select("doc_id", F.round("ppl", 4).alias("ppl"), "held_out")


@query(f"with {PAIRS} select doc_id, round(pow(10, -score / greatest(words, 1)), 4) as ppl, held_out from s join h using (doc_id)")
def kneser_ney_perplexity(spark, sf_dir):
    return _perplexities(spark, sf_dir, 2).select("doc_id", F.round("ppl", 4).alias("ppl"), "held_out")


@query(f"with {PAIRS}, v as (select list_sort(list(pow(10, -score / greatest(words, 1)))) as v from s join h using (doc_id) where held_out) select p, round(v[1 + least(len(v) - 1, len(v) * p // 100)], 4) as ppl from v, (values (50), (75), (90), (95), (99)) t(p)")
def perplexity_thresholds(spark, sf_dir):
    held = _perplexities(spark, sf_dir, 2).where("held_out")
    return languages.nearest_rank(held, "ppl", [50, 75, 90, 95, 99]).select("p", F.round("value", 4).alias("ppl"))


@query(f"with {PAIRS} select doc_id from s where pow(10, -score / greatest(words, 1)) <= 300")
def perplexity_filter_300(spark, sf_dir):
    """The threshold fits the tables' model; people choose it from the hold-out's percentiles."""
    return languages.perplexity_filter(_perplexities(spark, sf_dir, 2), 300.0).select("doc_id")


@query("with v as (select list_sort(list(n_chars)) as v from documents) select p, v[1 + least(len(v) - 1, len(v) * p // 100)] as n_chars from v, (values (50), (75), (90), (95), (99)) t(p)")
def nearest_rank_lengths(spark, sf_dir):
    return languages.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", [50, 75, 90, 95, 99]).select("p", F.col("value").alias("n_chars"))


# leaks

WORDS = rf"regexp_extract_all(lower(text), '{W}')"


def grams_sql(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i : i + {n - 1}], ' '))"


def whole_sql(words: str, n: int) -> str:
    return f"case when len({words}) >= {n} then {grams_sql(words, n)} when len({words}) > 0 then [array_to_string({words}, ' ')] else [] end"


def _leak_sql(words: str, n: int) -> str:
    return f"""with d as (select doc_id, {words} as w from documents), b as (select {words} as w from benchmark),
g as (select distinct unnest({whole_sql('w', n)}) as gram from b) select distinct doc_id from (select doc_id, unnest({whole_sql('w', n)}) as gram from d) semi join g using (gram)"""


@query(f"""with d as (select doc_id, {WORDS} as w from documents), b as (select {WORDS} as w from benchmark),
g as (select distinct unnest({grams_sql('w', 8)}) as gram from b where len(w) >= 8), s as (select distinct array_to_string(w, ' ') as s from b where len(w) between 3 and 7),
x as (select distinct doc_id from (select doc_id, unnest({grams_sql('w', 8)}) as gram from d where len(w) >= 8) semi join g using (gram)),
y as (select distinct doc_id from d, s where contains(array_to_string(w, ' '), s))
select doc_id, x.doc_id is not null as by_gram, y.doc_id is not null as by_short from x full join y using (doc_id)""")
def decontaminate_corpus_n8(spark, sf_dir):
    return decontaminate.corpus_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=8)


@query(_leak_sql(r"list_filter(regexp_split_to_array(lower(text), '[\s\p{Z}]+'), lambda x: x <> '')", 6))
def decontaminate_mcq_n6(spark, sf_dir):
    return decontaminate.item_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=6, punctuation=True)


@query(_leak_sql(WORDS, 6))
def decontaminate_science_n6(spark, sf_dir):
    return decontaminate.item_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=6)


@query(f"""with d as (select doc_id, {WORDS} as w from documents), b as (select item_id, {WORDS} as w from benchmark),
g as (select distinct unnest({whole_sql('w', 8)}) as gram from b),
x as (select distinct doc_id from (select doc_id, unnest({whole_sql('w', 8)}) as gram from d) semi join g using (gram)),
y as (select distinct doc_id from (select doc_id, list_distinct(w) as s from d) d, (select list_distinct(w) as v from b) b where len(list_intersect(s, v)) >= 0.6 * (len(s) + len(v) - len(list_intersect(s, v))) and len(list_intersect(s, v)) > 0)
select doc_id from x union select doc_id from y""")
def prompt_guard_j06(spark, sf_dir):
    return decontaminate.prompt_guard(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=8, jaccard=0.6)


@query(f"""with g as (select distinct unnest({whole_sql('w', 8)}) as gram from (select list_filter(regexp_split_to_array(lower(text), '[\\s\\p{{Z}}]+'), lambda x: x <> '') as w from benchmark))
select distinct doc_id from documents, g where contains(lower(text), gram)""")
def prompt_grams_raw_n8(spark, sf_dir):
    return decontaminate.raw_grams(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=8)


@query(ORACLES["decontaminate_corpus_n8"].replace("from benchmark)", "from (select text from benchmark union all select text from conversations where role = 'user'))"))
def decontaminate_extra_n8(spark, sf_dir):
    """What users asked joins the evaluation items as an extra source."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("text")
    return decontaminate.corpus_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text").unionByName(asked), n=8)


# funnels: language, bleed, perplexity, leaks, in this order, each over what the one before has kept

STAGES = ("language", "bleed", "perplexity", "leak")
FUNNEL = f"""with l as ({ORACLES['language_filter_en']}), fluent as ({ORACLES['perplexity_filter_300']}), k as ({ORACLES['decontaminate_corpus_n8']}),
j as (select doc_id, case when doc_id not in (select doc_id from l) then 'language' when coalesce(f + h + d, 0) > 2 or t then 'bleed' when doc_id not in (select doc_id from fluent) then 'perplexity'
  when doc_id in (select doc_id from k) then 'leak' end as reason from ({HITS}))"""


def _screens(spark, sf_dir, most, own):
    """The four stages for rows of ``doc_id`` and ``text``; the models come from all documents.  ``own``: the rows are documents, whose counts are at hand."""
    docs = table(spark, sf_dir, "documents")

    def language(rows):
        scored = _languages(spark, sf_dir, rows)
        return rows.join(languages.language_filter(scored, "en", 0.65).select("doc_id"), "doc_id", "left_anti")

    def perplexity(rows):
        forms = languages.normal_forms(docs)
        asked = forms if own else languages.normal_forms(rows)
        scored = languages.perplexity(asked, languages.perplexity_model(forms, order=2), order=2)
        return rows.join(languages.perplexity_filter(scored, most).select("doc_id"), "doc_id", "left_anti")

    return [
        ("language", language),
        ("bleed", lambda rows: rows.where(screen.bleed_reason("text", ENGLISH).isNotNull())),
        ("perplexity", perplexity),
        ("leak", lambda rows: decontaminate.corpus_leaks(rows, table(spark, sf_dir, "benchmark"), n=8)),
    ]


def _judged(spark, sf_dir):
    return screen.in_order(table(spark, sf_dir, "documents").select("doc_id", "text"), _screens(spark, sf_dir, 300.0, own=True))


@query(FUNNEL + " select doc_id, reason from j")
def corpus_funnel(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "reason")


@query(FUNNEL + """, s as (select pos, stage, (select count(*) from j where reason = stage) as dropped from (values (0, 'language'), (1, 'bleed'), (2, 'perplexity'), (3, 'leak')) t(pos, stage)),
r as (select *, sum(dropped) over (order by pos) as gone, (select count(*) from j) as total from s)
select stage, cast(total - gone + dropped as bigint) as rows_in, dropped, cast(total - gone as bigint) as kept, round((total - gone) / total, 6) as share from r""")
def corpus_funnel_report(spark, sf_dir):
    return screen.funnel_report(_judged(spark, sf_dir), [*STAGES])


@query(FUNNEL + " select coalesce(reason, 'kept') as reason, count(*) as n from j group by all")
def drop_stats(spark, sf_dir):
    from sieveyard.sources.sinks import stats

    return stats(_judged(spark, sf_dir))


# conversations

CONV = "c as (select conv_id, list({'turn': turn, 'role': role, 'text': coalesce(text, '')} order by turn) as t from conversations group by conv_id)"


@query(f"with {CONV} select conv_id, cast(len(t) as int) as turns, md5(array_to_string(list_transform(t, lambda x: x.text), chr(10))) as digest from c")
def conversation_text(spark, sf_dir):
    c = screen.conversations(table(spark, sf_dir, "conversations"))
    return c.select("conv_id", F.size("turns").alias("turns"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(rf"""with {CONV}, a as (select conv_id, list_transform(list_filter(t, lambda x: x.role = 'assistant'), lambda x: x.text) as a from c),
s as (select conv_id, a, list_filter(list_transform(flatten(list_transform(a, lambda x: regexp_split_to_array(x, '[.!?][\s\p{{Z}}]+'))), lambda x: trim(x, chr(10) || ' ')), lambda x: length(x) > 15) as s from a)
select conv_id, array_to_string(list_filter([case when regexp_matches(array_to_string(a, ' '), '(?i)quelle|fuente') then 'source_leak' end, case when regexp_matches(array_to_string(a, ' '), '(?i)(^|[^\p{{L}}])(ich|yo)([^\p{{L}}]|$)') then 'first_person' end,
  case when len(s) > len(list_distinct(s)) then 'echo' end], lambda x: x is not null), ',') as reasons from s""")
def grounding_reasons_15(spark, sf_dir):
    """The patterns and the length fit the tables' languages; the fixed ones are tested on planted rows."""
    c = screen.conversations(table(spark, sf_dir, "conversations"))
    out = screen.grounding_reasons(c, leak="(?i)quelle|fuente", person=r"(?i)(^|[^\p{L}])(ich|yo)([^\p{L}]|$)", longer_than=15)
    return out.select("conv_id", F.array_join("reasons", ",").alias("reasons"))


def _sft(spark, sf_dir):
    """Stages of a conversation screen: those of the corpus, with the threshold of the register, then near copies by the vectors of the same ids."""
    convs = screen.conversations(table(spark, sf_dir, "conversations")).select(F.col("conv_id").alias("doc_id"), "text")
    v = table(spark, sf_dir, "embeddings")

    def copies(rows):
        own = v.join(rows.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        return vectors.greedy_near_duplicates(own, threshold=0.2).where("not kept").select(F.col("vec_id").alias("doc_id"))

    return screen.in_order(convs, [*_screens(spark, sf_dir, 32000.0, own=False), ("copy", copies)])


@query()
def sft_screen(spark, sf_dir):
    """Rows only: no SQL for it.  The stages' models have theirs in the queries over documents; a test holds the order of stages."""
    return _sft(spark, sf_dir).select(F.col("doc_id").alias("conv_id"), "reason")


@query()
def sft_review_300(spark, sf_dir):
    kept = _sft(spark, sf_dir).where("reason is null").select("doc_id")
    return preferences.seeded_sample(kept, 300, id_col="doc_id").select(F.col("doc_id").alias("conv_id"))


def hits_sql(x: str) -> str:
    return rf"(len(regexp_extract_all(lower({x}), '{FOREIGN}')) + len(list_filter(regexp_extract_all(lower({x}), '{W}'), lambda w: regexp_matches(w, '[a-z]') and regexp_matches(w, '[0-9]'))) + len(list_filter(regexp_extract_all({x}, '{W}'), lambda w: regexp_matches(w, '^[Qq]q'))))"


TERM = "'nicht|avec|cuando|wasser'"


@query(f"""with {CONV}, x as (select conv_id, t, t[2].text as a from c where len(t) = 2 and t[1].role = 'user')
select conv_id, md5(t[1].text) as prompt, length(a) as chars from x where length(a) between 600 and 2500 and not regexp_matches(a, '(?i)language model') and len(regexp_extract_all(lower(a), '[a-z]')) / greatest(length(a), 1) >= 0.55
and {hits_sql('a')} <= 2 and not regexp_matches(lower(a), {TERM})""")
def depth_candidates_en(spark, sf_dir):
    c = screen.conversations(table(spark, sf_dir, "conversations"))
    out = screen.depth_candidates(c, ENGLISH, boilerplate="(?i)language model")
    return out.select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("prompt"), F.length("original").cast("long").alias("chars"))


@query(rf"""with {CONV}, x as (select conv_id, t, array_to_string(list_transform(t, lambda x: x.text), ' ') as s, coalesce(list_sum(list_transform(list_filter(t, lambda x: x.role = 'assistant'), lambda x: length(x.text))), 0) as n, len(list_filter(t, lambda x: x.role = 'assistant')) as k from c)
select conv_id, cast(n as bigint) as answer_chars from x where len(t) between 2 and 8 and t[1].role = 'user' and k > 0 and n between 250 and 2500 and not regexp_matches(s, '(?i)language model') and len(regexp_extract_all(s, '[a-z]')) / greatest(length(s), 1) >= 0.55
and {hits_sql('s')} = 0 and not regexp_matches(lower(s), {TERM}) order by conv_id limit 2000""")
def salvage_en(spark, sf_dir):
    c = screen.conversations(table(spark, sf_dir, "conversations"))
    return screen.salvage(c, ENGLISH, bad="(?i)language model", deixis="(?i)language model").select("conv_id", F.col("answer_chars").cast("long").alias("answer_chars"))


# projections

@query(rf"""select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[.!?…]+'), lambda s: regexp_replace(s, '[\s\p{{Z}}]+', '', 'g') <> '')) as int) as sentences, cast(len({WORDS}) as int) as words,
cast(len(list_filter(regexp_split_to_array(lower(text), '[\s\p{{Z}}]+'), lambda x: x <> '')) as int) as tokens, length(regexp_replace(text, '[.,\s\p{{Z}}]', '', 'g')) as packed from documents""")
def text_measures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.sentences("text")).alias("sentences"), F.size(T.words("text")).alias("words"), F.size(T.tokens("text")).alias("tokens"), F.length(T.digits_only("text")).cast("long").alias("packed"))


@query(r"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '([^\p{L}\p{N}\s])', ' \1 ', 'g'), '[\s\p{Z}]+', ' ', 'g'))) as digest from documents")
def lm_normal_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.lm_normal("text").cast("binary")).alias("digest"))


@query("""with d as (select doc_id, text, unnest(range(0, greatest(length(text) - 150, 1), 1050)) as pos from documents where text is not null)
select doc_id, cast(pos // 1050 as int) as chunk, length(substr(text, pos + 1, 1200)) as chars, md5(substr(text, pos + 1, 1200)) as digest from d where length(substr(text, pos + 1, 1200)) >= 200""")
def passage_chunks(spark, sf_dir):
    from sieveyard.operators.vectors import chunk_texts

    out = chunk_texts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "chunk", F.length("passage").cast("long").alias("chars"), F.md5(F.col("passage").cast("binary")).alias("digest"))


@query("select doc_id, first_id, doc_id = first_id as kept from (select doc_id, case when text is null then doc_id else min(doc_id) over (partition by text) end as first_id from documents)")
def exact_duplicates(spark, sf_dir):
    return lookup.exact_duplicates(table(spark, sf_dir, "documents"))


TOPICS = "('the'), ('and'), ('der'), ('la'), ('que'), ('zzz')"


@query(f"""with t as (select topic from (values {TOPICS}) t(topic)), m as (select topic, doc_id, text from documents, t where length(text) > 600 and contains(lower(substr(text, 1, 100)), topic))
select topic, doc_id, md5(substr(text, 1, 2500)) as digest from (select *, row_number() over (partition by topic order by length(text) desc, doc_id) as r from m) where r = 1""")
def topic_passages_longest(spark, sf_dir):
    topics = spark.sql(f"select * from values {TOPICS} t(topic)")
    out = lookup.topic_passages(topics, table(spark, sf_dir, "documents"))
    return out.select("topic", "doc_id", F.md5(F.col("passage").cast("binary")).alias("digest"))


@query(f"""with t as (select topic from (values {TOPICS}) t(topic)), m as (select topic, doc_id, text, length(text) > 2500 as long from documents, t where length(text) > 600 and contains(lower(substr(text, 1, 100)), topic))
select topic, doc_id, md5(substr(text, 1, 2500)) as digest from (select *, row_number() over (partition by topic order by long desc, case when long then doc_id else length(text) end desc, doc_id) as r from m) where r = 1""")
def topic_passages_reference(spark, sf_dir):
    topics = spark.sql(f"select * from values {TOPICS} t(topic)")
    out = lookup.topic_passages(topics, table(spark, sf_dir, "documents"), mode="reference")
    return out.select("topic", "doc_id", F.md5(F.col("passage").cast("binary")).alias("digest"))


@query("select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is not null then cast(l.quality as varchar) else d.lang end as value from documents d full join labels l on d.doc_id = l.doc_id")
def curated_override(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("value"))
    curated = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("value"))
    return lookup.override(base, curated, "doc_id", "value")
