"""Operators on planted rows: adversarial strings, corrupted keys, silent voters, published figures."""

import datetime as dt
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from sieveyard.functions import text as T
from sieveyard.functions.packs import ENGLISH, MACEDONIAN
from sieveyard.operators import decontaminate, evaluation, gates, juries, lookup, preferences, problems, screen, teachers, vectors
from sieveyard.sources import readers, sinks
from sieveyard.streaming import resume


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_words_and_grams(spark):
    odd = "Здраво, свету! a²_b ½ c-d"
    assert one(spark, odd, T.words("x")) == re.findall(r"\w+", odd.lower())
    assert one(spark, odd, T.tokens("x")) == odd.lower().split()
    assert one(spark, "a b c", T.ngrams(T.words("x"), 4)) == []
    assert one(spark, "a b c", T.ngrams_or_whole(T.words("x"), 4)) == ["a b c"]
    assert one(spark, "", T.ngrams_or_whole(T.words("x"), 4)) == []
    assert one(spark, "a b c", T.ngrams(T.words("x"), 2)) == ["a b", "b c"]
    assert one(spark, None, T.words("x")) is None
    assert one(spark, "éa", T.nfc("x")) == "éa"
    assert one(spark, "A_b, c!", T.lm_normal("x")) == "a _ b , c !"
    assert one(spark, "One. Two?!  … Three", F.size(T.sentences("x"))) == 3


@pytest.mark.parametrize(("text", "number", "hit"), [("it is 16, 20", "1620", True), ("1.620 in all", "1620", True), ("16200", "1620", False), ("31620", "1620", False), ("so 5 or 15", "5", True), ("so 15", "5", False), ("so 5 or x", "5", True), ("", "5", False), ("x", "", False), ("a.b", "a", True), ("11", "1", False), ("x and 22", "2", False), ("2, a 22", "2", True)])
def test_numbers_between_digits(spark, text, number, hit):
    df = spark.createDataFrame([(text, number)], "t string, n string")
    assert df.select(T.has_number("t", "n").alias("y")).first()["y"] is hit


@pytest.mark.parametrize(("value", "shown"), [(3.0, "3"), (2.5, "2.5"), (2.0 / 3, "0.67"), (100.0, "100"), (0.1, "0.1"), (1234.5, "1234.5")])
def test_number_text(spark, value, shown):
    assert one(spark, value, T.number_text("x"), "double") == shown


def test_replies(spark):
    assert one(spark, "x ```json\n{\"a\": 1}\n``` y", T.json_object("x")) == '{"a": 1}'
    assert one(spark, "none", T.json_object("x")) is None
    assert one(spark, "odg. в Б", T.answer_index("x")) == 2
    assert one(spark, "...", T.answer_index("x")) is None
    assert one(spark, "<think>a</think> yes <end_of_turn> no", T.clean_answer("x")) == "yes"


def reference_hits(text):
    low = text.lower()
    return len(re.findall("[ђћъщюяйьэыёѣѫѭѩіїєґў]", low)) + sum(bool(re.search("[а-шѓќѕџљњј]", w) and re.search("[a-z]", w)) for w in re.findall(r"\w+", low)) + len(re.findall(r"\b[Лл]ј", text))


@pytest.mark.parametrize("text", ["Сe на сe", "љубов и Љубов лјубов Лјиљана илјада", "ЩЪЮ ёй", "чист текст", "a_б б_a", "", "и́ ѐ ѝ", "x²б"])
def test_script_hits(spark, text):
    assert one(spark, text, screen.script_hits("x", MACEDONIAN)) == reference_hits(text)


def test_terms_match_inside_words(spark):
    assert one(spark, "незатачното", screen.has_term("x", MACEDONIAN))
    assert not one(spark, "незатачното", screen.has_term("x", MACEDONIAN, word_boundary=True))
    assert one(spark, None, screen.has_term("x", MACEDONIAN)) is False
    assert one(spark, "хвала и врло", screen.terms_found("x", MACEDONIAN)) == ["врло", "хвала"]
    assert one(spark, "ййй", screen.bleed_reason("x", MACEDONIAN)) == "script" and one(spark, "йй", screen.bleed_reason("x", MACEDONIAN)) is None


def turns(spark, *texts, roles=("user", "assistant")):
    return screen.conversations(spark.createDataFrame([(1, i, roles[i % 2], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string"))


def test_grounding(spark):
    same = "This sentence is repeated and has more than forty characters"
    got = screen.grounding_reasons(turns(spark, "видов нешто", f"Според текстот е така. {same}. Крај.", "q", f"{same}! И јас видов."), longer_than=40).first()
    assert got["reasons"] == ["source_leak", "first_person", "echo"]
    assert screen.grounding_reasons(turns(spark, "слушнав, според изворот", "чисто")).first()["reasons"] == []


def test_decontamination_rules_differ(spark):
    evals = spark.createDataFrame([(0, "one two three four five six seven eight nine"), (1, "short text here"), (2, "x y")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "zz one two three four five six seven eight"), (1, "a SHORT, text-here too"), (2, "xx y x y"), (3, "one, two three four five six"), (4, None), (5, "")], "doc_id long, text string")
    assert {r["doc_id"] for r in decontaminate.corpus_leaks(docs, evals).collect()} == {0, 1}
    assert {r["doc_id"] for r in decontaminate.item_leaks(docs, evals, 6).collect()} == {0, 3}
    assert {r["doc_id"] for r in decontaminate.item_leaks(docs, evals, 6, punctuation=True).collect()} == {0}
    assert {r["doc_id"] for r in decontaminate.prompt_guard(docs, evals).collect()} == {0, 1, 2, 3}


def test_greedy_is_neither_components_nor_any_earlier(spark):
    angle = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d))]
    rows = spark.createDataFrame([(i, angle(d)) for i, d in enumerate((0, 20, 40, 60, 200))], "vec_id long, embedding array<double>")
    kept = {r["vec_id"] for r in vectors.greedy_near_duplicates(rows, threshold=0.92).where("kept").collect()}
    assert kept == {0, 2, 4}


def test_gates(spark):
    assert one(spark, "```python\nx = 1\n```", gates.code_block(F.col("x"), F.lit("python")))
    assert not one(spark, "```python\nx = = 1\n```", gates.code_block(F.col("x"), F.lit("python")))
    assert not one(spark, "```python\nx = 1\n```\nand\n```Python\nx = = 1\n```", gates.code_block(F.col("x"), F.lit("python")))
    assert one(spark, "```text\nx = = 1\n```", gates.code_block(F.col("x"), F.lit("python"))) and one(spark, "```py\nx = = 1\n```", gates.code_block(F.col("x"), F.lit("python")))
    assert not one(spark, "```\nx = = 1\n```", gates.code_block(F.col("x"), F.lit("python"))) and not one(spark, None, F.coalesce(gates.code_block(F.col("x"), F.lit("python")), F.lit(False)))
    assert not one(spark, "no block", gates.code_block(F.col("x"), F.lit("python")))
    assert one(spark, "резултатот е 12,5 км", gates.answer_present(F.col("x"), F.lit("12.5")))
    assert one(spark, 2, gates.choice_shape(F.array(*map(F.lit, "abcd")), F.col("x")), "int") and not one(spark, 4, gates.choice_shape(F.array(*map(F.lit, "abcd")), F.col("x")), "int")
    ok, kept = gates.paraphrases(F.transform(F.sequence(F.lit(1), F.col("x")), lambda i: F.lit("v")), ENGLISH)
    assert one(spark, 12, ok, "int") and len(one(spark, 12, kept, "int")) == 10 and not one(spark, 7, ok, "int")
    assert not one(spark, "текст mixед", gates.clean_language(F.col("x"), MACEDONIAN))
    held = spark.createDataFrame([("a", 6)], "cell string, n long")
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)], "id long, cell string")
    assert gates.variety_cap(rows, ["cell"], F.col("id"), existing=held).groupBy("cell").count().collect().__len__() == 2
    assert gates.variety_cap(rows, ["cell"], F.col("id"), existing=held).where("cell = 'a'").count() == 2


def test_silent_voters_and_wrong_keys(spark):
    votes = spark.createDataFrame([(1, True), (1, True), (1, None), (2, True), (2, None), (3, True), (3, False), (4, None)], "id long, vote boolean")
    kept = lambda **k: {r["id"] for r in juries.entailment_panel(votes, **k).where("kept").collect()}
    assert kept() == {1, 2} and kept(allow_single=False) == {1}
    cold = spark.createDataFrame([(i, 0, v) for i, vs in enumerate(((0, 0, 1), (1, 1, 1), (0, None, None))) for v in vs], "id long, key int, vote int")
    assert {r["id"]: r["outcome"] for r in juries.cold_panel(cold).collect()} == {0: "kept", 1: "dropped", 2: "unresolved"}
    df = spark.createDataFrame([([True, True], ["a", "b"], True), ([True], ["a", "b"], True), (None, ["a"], True)], "v array<boolean>, c array<string>, s boolean")
    assert [r["y"] for r in df.select(juries.entails(F.col("v"), F.col("c"), F.col("s")).alias("y")).collect()] == [True, False, None]


#: Published accuracies and standard errors of two models on ten tasks.
BATTERY = [
    ("exams", 0.5469879518072289, 0.010930483688602534, 0.5277108433734939, 0.010962197452131738), ("copa", 0.757, 0.01356964019917743, 0.733, 0.01399667485179628),
    ("include", 0.5604203152364273, 0.020789225680572388, 0.5604203152364273, 0.020789225680572388), ("arc_easy", 0.5273569023569024, 0.010244415164390537, 0.5484006734006734, 0.010211600726405222),
    ("arc_challenge", 0.34726962457337884, 0.013913034529620444, 0.3387372013651877, 0.01383056892797433), ("boolq", 0.7807339449541284, 0.0072365200925592526, 0.7889908256880734, 0.007136400014014268),
    ("hellaswag", 0.47540330611431986, 0.004983740145218606, 0.4523999203345947, 0.004967118575905275), ("piqa", 0.6871599564744287, 0.010817714425701095, 0.6849836779107725, 0.010838072746240653),
    ("winogrande", 0.6140489344909235, 0.01368203699339741, 0.6337805840568271, 0.013540144376588905), ("openbookqa", 0.326, 0.020984009562393567, 0.304, 0.02059164957122493),
]


def test_published_averages(spark):
    rows = [("first", t, a, s) for t, a, s, _, _ in BATTERY] + [("second", t, a, s) for t, _, _, a, s in BATTERY]
    results = spark.createDataFrame(rows, "model string, task string, acc double, stderr double")
    averages = evaluation.suite_average(results)
    assert {r["model"]: round(r["average"], 4) for r in averages.collect()} == {"first": 0.5622, "second": 0.5572}
    assert round(evaluation.z_score(averages, "first", "second").first()["z"], 4) == 0.8213
    margins = lambda *s: tuple(round(x, 4) for x in evaluation.subset_margin(results, list(s), "first", "second").first())
    assert margins("exams", "copa", "include") == (0.0144, 0.0010) and margins("exams", "include") == (0.0096, 0.0038)


def test_problems_are_right(spark):
    for r in problems.problems(spark, 400, seed=3).collect():
        n = [int(x) for x in re.findall(r"\d+", r["problem"])]
        want = {
            "pct": lambda: n[0] * n[1] / 100, "prop": lambda: n[1] * n[2], "speed": lambda: n[0] / n[1], "area": lambda: n[0] * n[1], "split": lambda: n[0] / n[1], "discount": lambda: n[0] * (100 - n[1]) / 100,
            "avg": lambda: sum(n) / len(n), "interest": lambda: n[0] * n[1] * n[2] / 100, "mix": lambda: n[0] * n[1] + n[2] * n[3],
        }.get(r["kind"])
        if want:
            assert abs(float(r["answer"]) - want()) <= 0.0051
        else:
            total = n[0] * 60 + n[1] + n[2]
            assert r["answer"] == f"{total // 60}:{total % 60:02d}"


def test_passages_and_overrides(spark):
    docs = spark.createDataFrame([(0, "Topic a " + "x" * 700), (1, "topic A " + "y" * 3000), (2, "topic a " + "z" * 2700), (3, "late " + "w" * 700 + " topic a")], "doc_id long, text string")
    topics = spark.createDataFrame([("Topic A",)], "topic string")
    assert lookup.topic_passages(topics, docs).first()["doc_id"] == 1
    assert lookup.topic_passages(topics, docs, mode="reference").first()["doc_id"] == 2
    assert len(lookup.topic_passages(topics, docs).first()["passage"]) == 2500


def test_bleed_substitutes_once(spark):
    rows = spark.createDataFrame([(1, "Многу многу точно"), (2, "ништо од ова"), (3, "none")], "conv_id long, chosen string")
    got = {r["conv_id"]: r["rejected"] for r in preferences.bleed_rejected(rows).collect()}
    assert got[1] == "врло многу тачно" and got[2] == "нищо од ова" and got[3] is None


def test_mixed_sources_round_trip(spark, tmp_path):
    import gzip

    p = tmp_path / "a.jsonl.gz"
    with gzip.open(p, "wt", encoding="utf-8") as f:
        f.write('{"text": "еден", "source": "a", "n": 1}\n\n{"text": null, "source": "b", "n": 2}\n')
    rows = readers.jsonl(spark, str(p), "text string, source string, n int", parts=2)
    assert rows.count() == 2 and readers.jsonl(spark, str(p), "text string, source string", ["a"]).count() == 1 and readers.field(spark, str(p)).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        (tmp_path / "bad.jsonl").write_text("{nope\n")
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "text string").collect()
    (tmp_path / "t.tsv").write_text('src_text\tb\n"quoted\t1\nshort\n\t3\n', encoding="utf-8")
    assert sorted(r[0] for r in readers.tsv(spark, str(tmp_path / "t.tsv"), "src_text").collect()) == ['"quoted', "short"]
    (tmp_path / "terms.txt").write_text("# c\n Да \nда\n\nне\n", encoding="utf-8")
    assert sorted(r[0] for r in readers.terms(spark, str(tmp_path / "terms.txt")).collect()) == ["да", "не"]
    (tmp_path / "r.md").write_text("# x\n## id a-1 q\ntext ## id no\n## id b\n", encoding="utf-8")
    assert sorted(r[0] for r in readers.markdown_ids(spark, str(tmp_path / "r.md")).collect()) == ["a-1", "b"]
    (tmp_path / "t.yaml").write_text("law:\n  tier: pro\n  count: 40\n  subtopics:\n    - one\n    - two\nart:\n  subtopics: [x, y]\n", encoding="utf-8")
    assert readers.topics(str(tmp_path / "t.yaml")) == {"law": {"tier": "pro", "count": 40, "subtopics": ["one", "two"]}, "art": {"subtopics": ["x", "y"]}}
    judged = rows.withColumn("reason", F.when(F.col("text").isNull(), "empty"))
    sinks.split(judged, str(tmp_path / "kept"), str(tmp_path / "dropped"))
    assert spark.read.json(str(tmp_path / "dropped")).first()["reason"] == "empty" and "reason" not in spark.read.json(str(tmp_path / "kept")).columns
    assert {r["reason"]: r["n"] for r in sinks.stats(judged).collect()} == {"kept": 1, "empty": 1}
    sinks.review(rows, str(tmp_path / "review.md"), "Review", "n", F.col("text"), [F.col("n")], 1)
    assert "## id 1" in (tmp_path / "review.md").read_text()
    sinks.census_markdown({"a": sinks.stats(judged)}, str(tmp_path / "c.md"))
    assert "| empty | 1 |" in (tmp_path / "c.md").read_text()


def test_resume_adds_nothing_twice(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    out = str(tmp_path / "out")
    assert resume.append_new(spark, rows, lambda d: d, out) == 2
    assert resume.append_new(spark, rows.union(spark.createDataFrame([(3, "c")], rows.schema)), lambda d: d, out) == 3
    assert resume.append_new(spark, rows, lambda d: d, out) == 3
    src = tmp_path / "src"
    src.mkdir()
    (src / "1.json").write_text('{"id": 1, "text": "a"}\n{"id": 1, "text": "a"}\n')
    run = lambda: resume.resumable(spark, str(src), rows.schema, lambda d: d, str(tmp_path / "stream"), str(tmp_path / "chk")).awaitTermination()
    run()
    (src / "2.json").write_text('{"id": 2, "text": "b"}\n')
    run()
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "stream")).collect()) == [1, 2]


def test_router(spark):
    calls = []

    def busy(prompt):
        calls.append(prompt)
        raise teachers.Busy

    r = teachers.Router({"a": busy, "b": teachers.offline}, {"a": 1.0, "b": 0.0}, cap=10_000)
    assert json.loads(r.ask("p"))["user"] and len(calls) == 3 and r.resting == {"a": 11}
    assert r.ask("q") and len(calls) == 3
    assert teachers.Router({"b": teachers.offline}, {"b": 1.0}, cap=0).ask("p") is None
    assert teachers.is_peak(((1, 4), (6, 10)), dt.datetime(2026, 1, 1, 9)) and not teachers.is_peak(((1, 4), (6, 10)), dt.datetime(2026, 1, 1, 4))
    got = teachers.generate(spark.createDataFrame([("x",)], "prompt string"), lambda: teachers.Router({"b": teachers.offline}, {"b": 1.0})).first()
    assert got["reply"] == teachers.offline("x")
    ledger = spark.createDataFrame([(1, 2, None), (None, 3, 4)], "in long, out long, think long")
    assert teachers.spent(ledger).first()["tokens"] == 10


def test_benchmark_forms(spark):
    item, ok = evaluation.include_item(F.lit(" q "), [F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("")], F.col("x"))
    assert one(spark, " b ", ok) is True and one(spark, "C", ok) is False and one(spark, "1", ok) is True and one(spark, "?", ok) is False
    assert one(spark, "b", item)["choices"] == ["a", "c"]
    copa = one(spark, "Premise..", evaluation.copa_item(F.col("x"), F.lit(True), F.lit("Yes it is"), F.lit("No"), F.lit(1)))
    assert copa["question"] == "Premise, затоа што" and copa["choices"] == ["yes it is", "no"]
    chat = turns(spark, "sys", "hello", roles=("system", "user")).select(evaluation.render_chat(F.col("turns")).alias("y")).first()["y"]
    assert chat == "<|turn>user\nsys\n\nhello<turn|>\n"


def test_stages_see_what_is_left(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "ab"), (3, "abc"), (None, "abc")], "doc_id long, text string")
    seen = []

    def fails(letter):
        def stage(rows):
            seen.append(rows.count())
            return rows.where(F.col("text").contains(letter))

        return stage

    got = {(r["doc_id"], r["reason"]) for r in screen.in_order(docs, [("c", fails("c")), ("b", fails("b"))]).collect()}
    assert got == {(1, None), (2, "b"), (3, "c"), (None, None)} and seen == [4, 3]


def test_leaks_by_inner_words(spark):
    items = spark.createDataFrame([(1, "xx the quick brown foxes ran"), (2, "the quick red fox"), (3, None), (4, ""), (5, "one two")], "doc_id long, text string")
    evals = spark.createDataFrame([("e quick brown fox",), ("Quick red",), (None,), ("",)], "text string")
    assert {r["doc_id"] for r in decontaminate.corpus_leaks(items, evals).where("by_short").collect()} == {1}
    assert {r["doc_id"] for r in decontaminate.raw_grams(items, evals).collect()} == {1, 2}


def test_vectors_with_nulls(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"] for r in vectors.greedy_near_duplicates(rows).where("not kept").collect()} == {2}
    top = vectors.top_passages(rows.where("vec_id in (1, 3)"), rows, k=9).collect()
    assert [(r["query_id"], r["passage_id"]) for r in sorted(top, key=lambda r: r["rank"])] == [(1, 1), (1, 2), (1, 6)]
    assert vectors.greedy_near_duplicates(rows.limit(0)).count() == 0 and vectors.top_passages(rows.limit(0), rows).count() == 0


def test_approved_terms_join_the_pack(spark, tmp_path):
    path = tmp_path / "approved.txt"
    path.write_text("# list\nВрло\nзборче\n\n", encoding="utf-8")
    pack = readers.approved_pack(spark, MACEDONIAN, str(path))
    assert set(pack.terms) == {*MACEDONIAN.terms, "зборче"} and one(spark, "едно зборче тука", screen.has_term("x", pack))


def test_one_cap_for_the_job(spark):
    prompts = spark.createDataFrame([(f"prompt {i} of some words",) for i in range(64)], "prompt string")
    make = lambda: teachers.Router({"a": teachers.offline}, {"a": 1.0}, cap=2000)
    answered = teachers.generate(prompts, make, tasks=4, already=1000).where("reply is not null").count()
    each = len("prompt 1 of some words".split()) + len(teachers.offline("x").split())
    assert 0 < answered <= 4 * (250 // each + 1)


def test_index_is_written_and_read(spark, tmp_path):
    passages = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "passage_id long, passage string")
    sinks.matrix_index(passages, spark.createDataFrame([(1, [1.0]), (3, [3.0]), (9, [9.0])], "passage_id long, embedding array<double>"), str(tmp_path / "index"))
    assert [(r["passage_id"], r["passage"], r["embedding"]) for r in readers.matrix_index(spark, str(tmp_path / "index")).orderBy("passage_id").collect()] == [(1, "a", [1.0]), (3, "c", [3.0])]


def test_five_word_model_with_nulls_empty_and_unknown_words(spark):
    from sieveyard.operators import languages

    texts = [(i, "a b c d e f") for i in range(1, 9)] + [(9, None), (10, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = languages.perplexity_model(languages.normal_forms(docs), order=5, held_out_every=10**9)
    asked = spark.createDataFrame([(1, "a b c d e f"), (2, "f e d c b a"), (3, "x y"), (4, ""), (5, None)], "doc_id long, text string")
    ppl = {r.doc_id: r.ppl for r in languages.perplexity(languages.normal_forms(asked), model, order=5).collect()}
    assert set(ppl) == {1, 2, 3, 4} and ppl[1] < ppl[2] < ppl[3]

    none = docs.where("doc_id < 0")
    empty = languages.perplexity_model(languages.normal_forms(none), order=3)
    assert all(r.ppl is None for r in languages.perplexity(languages.normal_forms(asked), empty, order=3).collect())
    assert languages.perplexity(languages.normal_forms(none), model, order=5).count() == 0
