"""Row screens: foreign letters, mixed words, blocked terms, artefacts of grounding, selections by shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveyard.functions.packs import LanguagePack
from sieveyard.functions.text import WORD, col, letters_share
from sieveyard.sources.staging import stage


def foreign_letters(text: Column | str, pack: LanguagePack) -> Column:
    return F.regexp_extract_all(F.lower(col(text)), F.lit(pack.foreign), F.lit(0))


def mixed_words(text: Column | str, pack: LanguagePack) -> Column:
    """Words with letters of both scripts."""
    if not pack.own or not pack.other:
        return F.array().cast("array<string>")
    return F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0)), lambda w: w.rlike(pack.own) & w.rlike(pack.other))


def digraphs(text: Column | str, pack: LanguagePack) -> Column:
    if not pack.digraph:
        return F.array().cast("array<string>")
    return F.regexp_extract_all(col(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_]){pack.digraph}"), F.lit(0))


def script_hits(text: Column | str, pack: LanguagePack) -> Column:
    """Foreign letters, mixed words and digraphs together; a null text has none."""
    mixed, pairs = F.size(mixed_words(text, pack)), F.size(digraphs(text, pack))
    if pack.other:  # most texts have no such letter at all
        mixed = F.when(F.lower(col(text)).rlike(pack.other), mixed).otherwise(0)
    if pack.digraph:
        pairs = F.when(col(text).rlike(pack.digraph), pairs).otherwise(0)
    return F.when(col(text).isNull(), F.lit(0)).otherwise(F.size(foreign_letters(text, pack)) + mixed + pairs)


def has_term(text: Column | str, pack: LanguagePack, word_boundary: bool = False) -> Column:
    """A blocked term occurs anywhere, inside words too unless ``word_boundary``.  One alternation of the minimal terms."""
    terms = pack.terms if word_boundary else pack.minimal_terms()
    if not terms:
        return F.lit(False)
    alternatives = "|".join(rf"\Q{t}\E" for t in terms)
    pattern = rf"(?<![\p{{L}}\p{{N}}_])(?:{alternatives})(?![\p{{L}}\p{{N}}_])" if word_boundary else alternatives
    return F.coalesce(F.lower(col(text)).rlike(pattern), F.lit(False))


def terms_found(text: Column | str, pack: LanguagePack) -> Column:
    """All terms that occur, in order."""
    low = F.lower(col(text))
    return F.filter(F.array(*[F.lit(t) for t in sorted(pack.terms)]), lambda t: low.contains(t))


def bleed_reason(text: Column | str, pack: LanguagePack, tolerated: int = 2) -> Column:
    """``script``, ``term`` or null: why the bleed screen drops a text."""
    return F.when(script_hits(text, pack) > tolerated, "script").when(has_term(text, pack), "term")


def draft_terms(docs: DataFrame, pack: LanguagePack, top: int = 300, around: int = 40) -> DataFrame:
    """Candidate terms: words with a foreign letter, by count, with their number of documents and first context.

    Ties in the report go to the word first met in order of document, then to the word itself.
    """
    found = docs.where(F.lower("text").rlike(pack.foreign)).select("doc_id", "text", F.lower("text").alias("low"))
    each = found.select("doc_id", "text", "low", F.explode(F.filter(F.regexp_extract_all("low", F.lit(WORD), F.lit(0)), lambda w: w.rlike(pack.foreign))).alias("word"))
    per_doc = each.groupBy("word", "doc_id").agg(F.count("*").alias("n"))
    counts = per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    best = counts.orderBy(F.col("n").desc(), "first_doc", "word").limit(top)
    at = F.instr("low", F.col("word"))
    return best.join(found, best["first_doc"] == found["doc_id"]).select("word", "n", "docs", "first_doc", F.substring("text", F.greatest(at - around, F.lit(1)), F.length("word") + 2 * around).alias("context"))


def term_documents(docs: DataFrame, pack: LanguagePack) -> DataFrame:
    """``term, docs``: in how many documents each approved term occurs, inside words too; terms that occur nowhere are left out."""
    return docs.select(F.explode(terms_found("text", pack)).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


def census(docs: DataFrame, pack: LanguagePack, tolerated: int = 2) -> DataFrame:
    """Documents by sub-rule, each rule for itself so that overlaps show, and the total that the screen rejects."""
    letters, mixed, lj, term = F.size(foreign_letters("text", pack)), F.size(mixed_words("text", pack)), F.size(digraphs("text", pack)), has_term("text", pack)
    flags = docs.where(F.col("text").isNotNull()).select(letters.alias("f"), mixed.alias("h"), lj.alias("d"), term.alias("t"))
    rules = {
        "docs": F.lit(True), "docs_with_any_foreign_letter": F.col("f") > 0, "reject_letters": F.col("f") > tolerated, "reject_homoglyph": F.col("h") > tolerated,
        "hit_digraph": F.col("d") > 0, "reject_blocklist": F.col("t"), "rejected_total": (F.col("f") + F.col("h") + F.col("d") > tolerated) | F.col("t"),
    }
    return flags.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])


def letter_census(docs: DataFrame, pack: LanguagePack) -> DataFrame:
    """For each foreign letter its documents and occurrences."""
    each = docs.select("doc_id", F.explode(foreign_letters("text", pack)).alias("letter"))
    return each.groupBy("doc_id", "letter").agg(F.count("*").alias("n")).groupBy("letter").agg(F.count("*").alias("docs"), F.sum("n").alias("hits"))


def top_mixed(docs: DataFrame, pack: LanguagePack, tolerated: int = 2, top: int = 12) -> DataFrame:
    """The commonest mixed words of documents that have too many."""
    heavy = docs.select(mixed_words("text", pack).alias("m")).where(F.size("m") > tolerated)
    return heavy.select(F.explode("m").alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(top)


def conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: ``turns`` in order and their texts joined by line ends.  A null text counts as empty."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    folded = turns.groupBy("conv_id").agg(ordered.alias("turns"))
    return folded.withColumn("text", F.array_join(F.transform("turns", lambda t: t["text"]), "\n"))


def said_by(role: str) -> Column:
    return F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"])


#: How answers betray their source and how they adopt experiences.
SOURCE_LEAK = r"(?iu)извор(от|ите)?(?![\p{L}\p{N}_])|тој опис|описот|не пишува во|наведено (е )?во|според текстот|во текстот (што|кој)|од изворите|ги фатив од"
FIRST_PERSON = r"(?iu)(?<![\p{L}\p{N}_])(слушнав|видов|бев|отидов|ме повлекоа|доживеав|се сеќавам|јас лично (бев|видов|слушнав)|заедно (читаме|стоиме|одиме)|мојата (баба|мајка|сестра) ми (рече|кажа))(?![\p{L}\p{N}_])"


def echoes(texts: Column, longer_than: int = 40) -> Column:
    """A sentence of more than so many characters occurs twice among the texts or within one."""
    cut = F.flatten(F.transform(texts, lambda t: F.filter(F.transform(F.split(t, r"[.!?](?U:\s+)"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: F.length(s) > longer_than)))
    return F.size(cut) > F.size(F.array_distinct(cut))


def grounding_reasons(convs: DataFrame, leak: str = SOURCE_LEAK, person: str = FIRST_PERSON, longer_than: int = 40) -> DataFrame:
    """``reasons``: all that apply to a conversation's assistant turns, none left out for another."""
    answers = said_by("assistant")
    joined = F.array_join(answers, " ")  # a phrase may run on from turn to turn
    reasons = F.array_compact(F.array(F.when(joined.rlike(leak), F.lit("source_leak")), F.when(joined.rlike(person), F.lit("first_person")), F.when(echoes(answers, longer_than), F.lit("echo"))))
    return convs.withColumn("reasons", reasons)


#: Self-description of assistants, references to a text not shown, scripts that do not belong.
AI_BOILERPLATE = r"(?iu)вештачка интелигенција|јазичен модел|AI модел"
SALVAGE_BAD = r"(?iu)вештачка интелигенциј|јазичен модел|како модел|немам способност|не можам да пристапам|as an AI|language model|OpenAI|ChatGPT"
SALVAGE_DEIXIS = r"(?iu)наведен[\p{L}\p{N}_]+|дадениот текст|горенаведен[\p{L}\p{N}_]+|следнава статија|текстот што|статијата „|врз основа на текстот"
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}]"
MIXED_TAIL = r"(?<![\p{L}\p{N}_])(?:[а-шѓќѕџљњјА-ШЃЌЅЏЉЊЈ]+[a-zA-Z]{2,}[а-шѓќѕџљњј]*|[a-zA-Z]{2,}[а-шѓќѕџљњј]+)(?![\p{L}\p{N}_])"


def depth_candidates(convs: DataFrame, pack: LanguagePack, least: int = 600, most: int = 2500, share: float = 0.55, boilerplate: str = AI_BOILERPLATE) -> DataFrame:
    """Two turns, a user's first, an answer of fitting length in the language, without talk of models."""
    answer = F.col("turns")[1]["text"]
    ok = (F.size("turns") == 2) & (F.col("turns")[0]["role"] == "user")
    fits = F.length(answer).between(least, most) & ~answer.rlike(boilerplate) & (letters_share(answer, pack.own) >= share) & bleed_reason(answer, pack).isNull()
    return convs.where(ok & F.when(ok, fits)).select("conv_id", F.col("turns")[0]["text"].alias("prompt"), answer.alias("original"))


def salvage(convs: DataFrame, pack: LanguagePack, share: float = 0.55, bad: str = SALVAGE_BAD, deixis: str = SALVAGE_DEIXIS, top: int = 2000) -> DataFrame:
    """The first ``top`` conversations by id of 2 to 8 turns from a user, with 250 to 2500 characters of answers and no script hit at all."""
    text = F.array_join(F.transform("turns", lambda t: t["text"]), " ")
    total = F.aggregate(said_by("assistant"), F.lit(0), lambda n, t: n + F.length(t))
    ok = F.size("turns").between(2, 8) & (F.col("turns")[0]["role"] == "user") & (F.size(said_by("assistant")) > 0) & total.between(250, 2500)
    clean = ~text.rlike(bad) & ~text.rlike(deixis) & (letters_share(text, pack.own, ignore_case=False) >= share) & (script_hits(text, pack) == 0) & ~has_term(text, pack) & ~text.rlike(CJK) & ~text.rlike(MIXED_TAIL)
    return convs.where(ok & clean).orderBy("conv_id").limit(top).select("conv_id", total.alias("answer_chars"))


def funnel(docs: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """``reason``: the first stage that fails a row; null for rows that pass all.  Dropping is a step of its own."""
    failed = [F.when(F.coalesce(fails, F.lit(False)), F.lit(name)) for name, fails in stages]
    return docs.withColumn("reason", F.coalesce(*failed, F.lit(None).cast("string")))


def in_order(docs: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], id_col: str = "doc_id") -> DataFrame:
    """``id, reason``: the first stage that drops a row, null for rows that pass all.

    A stage takes the rows that are left and returns those it drops, so that a dear one works on few.  What it drops is staged.
    Rows that share an id go together; null ids stay.
    """
    left, dropped = docs, None
    for name, fails in stages:
        gone = stage(fails(left).select(id_col).distinct().withColumn("reason", F.lit(name)), "dropped")
        left = left.join(gone.select(id_col), id_col, "left_anti")
        dropped = gone if dropped is None else dropped.unionByName(gone)
    return docs.select(id_col).join(dropped, id_col, "left")


def funnel_report(judged: DataFrame, names: list[str]) -> DataFrame:
    """Rows in, dropped and kept by stage, and the share kept of all."""
    counted = judged.groupBy("reason").agg(F.count("*").alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    stages = judged.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, reason string")
    w = Window.orderBy("pos")
    dropped = F.coalesce("n", F.lit(0))
    out = stages.join(counted, "reason", "left").crossJoin(total).withColumn("dropped", dropped)
    gone = F.sum("dropped").over(w)
    return out.select(F.col("reason").alias("stage"), (F.col("total") - gone + F.col("dropped")).alias("rows_in"), "dropped", (F.col("total") - gone).alias("kept"), F.round((F.col("total") - gone) / F.greatest(F.col("total"), F.lit(1)), 6).alias("share"))
