"""Vectors, pages and the pipeline."""

import time

import numpy as np
import pytest

from sieveyard.llm import embedding_duplicates, exact_topk, main_text
from sieveyard.llm.components import local_labels

NAN, INF = float("nan"), float("inf")


def vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(260, 12)).astype(np.float32)
    for i in range(100, 180):
        x[i] = x[i - 100] + rng.normal(scale=0.08, size=12)
    x[200] = x[3]
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    rows += [(300, None, "c"), (301, [0.0] * 12, "c"), (302, [NAN] * 12, "c"), (303, [INF] + [1.0] * 11, "c"), (304, [None] + [1.0] * 11, "c"), (305, [], "c"), (None, [1.0] * 12, "c"), (306, [float(2 * v) for v in x[3]], "c")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, cell string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "vec_id long, embedding array<float>, cell string")


def test_embedding_duplicates_equal_brute_force(table, none):
    good = [(i, np.array(v, dtype=np.float64)) for i, v, _ in vectors() if i is not None and v and None not in v and np.isfinite(np.array(v)).all() and any(v)]
    ids = np.array([i for i, _ in good])
    x = np.stack([v for _, v in good])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    label = ids[local_labels(len(ids), *np.nonzero(link))]
    want = {int(i): (int(n), int(c)) for i, n, c in zip(ids, link.sum(axis=1), label)}
    for options in ({}, {"per_cell": 40, "tile": 16, "probes": 3}):
        got = embedding_duplicates.embedding_duplicates(table, **options).collect()
        assert len(got) == len(vectors())
        missed = 0
        for r in got:
            n, c = want.get(r["vec_id"], (0, r["vec_id"]))
            missed += r["n_links"] < n
            assert r["n_links"] <= n and (options or (r["n_links"], r["component_id"]) == (n, c))
        assert missed <= 0.1 * sum(n > 0 for n, _ in want.values())
    assert embedding_duplicates.embedding_duplicates(none).count() == 0


def test_recall_where_cells_far_outnumber_probes(spark):
    """6,000 vectors in 150 cells, 4 probed: pairs at a cosine of 0.90 to 0.93 are the hardest."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(5000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=(1000, 64))
    noise -= (noise * base[:1000]).sum(axis=1, keepdims=True) * base[:1000]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.9001, 0.93, (1000, 1))
    x = np.concatenate([base, cos * base[:1000] + np.sqrt(1 - cos * cos) * noise])
    got = embedding_duplicates.embedding_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), per_cell=40).collect()
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(r["n_links"] for r in got)
    assert 0.9 * link.sum() <= found <= link.sum(), found / link.sum()
    print("recall", found / link.sum())


def test_topk_equals_brute_force(table, none):
    good = [(i, np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v, _ in vectors() if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    got = {}
    for r in exact_topk.exact_topk(table, table.where("vec_id % 20 = 0 or vec_id > 299"), k=7, block=100, query_block=6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, v in good:
        if q % 20 == 0 or q > 299:
            scores = sorted((-int(v @ w) if len(v) == len(w) else 0, i) for i, w in good if i != q)[:7]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert set(got) == {q for q, _ in good if q % 20 == 0 or q > 299}
    assert exact_topk.exact_topk(none, none).count() == 0


def test_topk_of_few_and_huge(spark):
    rows = spark.createDataFrame([(1, [1e15, -3.0]), (2, [1e15, 2.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in exact_topk.exact_topk(rows.where("embedding[0] < 0"), rows.where("vec_id = 3"), k=5).collect()]
    assert got == []
    assert exact_topk.exact_topk(rows.where("vec_id > 1"), rows.where("vec_id = 2"), k=5).count() == 1


def test_threshold_stops_early_on_clear_winners():
    rng = np.random.default_rng(1)
    rows = rng.integers(-3, 4, (5000, 3)).astype(float)
    rows[17] = [900, 0, 0]
    lists = exact_topk.SortedLists(np.arange(5000), rows)
    best, score = lists.top(np.array([5.0, 0.0, 0.0]), 1, None)
    assert best[0] == 17 and score[0] == 4500


PAGES = {
    "plain": ("<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; x</h1><p>One <b>two</b>\n three.<p>Four&nbsp;five.</article><footer>f</footer></body></html>", "T & x\n\nOne two three.\n\nFour five."),
    "no article": ("<body><div id=menu><a>a</a> <a>b</a></div><div class=content><p>" + "Long text here. " * 20 + "</p><p>" + "More of it now. " * 20 + "</p></div><div class='sidebar'>s</div></body>", ("Long text here. " * 20).strip() + "\n\n" + ("More of it now. " * 20).strip()),
    "nested noise": ("<article><p>Body one.</p><div class='ad-slot'>Buy</div><p>Body two.</p><section id='comments'><p>Nice post</p></section><form><input>Send</form></article>", "Body one.\n\nBody two."),
    "script with tags": ("<body><script>var a='</p><p>x';</script><style>p{}</style><article><p>Kept &lt;b&gt;</p></article>", "Kept <b>"),
    "unclosed": ("<article><h1>H</h1><p><b>Bold start.<br><p>Next.<ul><li>a<li>b</ul>", "H\n\nBold start.\n\nNext.\n\na\n\nb"),
    "comment": ("<article><!-- <p>no</p> --><p>yes</p></article>", "yes"),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    html, want = PAGES[name]
    assert main_text.main_text(html) == want


def test_main_text_of_several_articles():
    one, two, side = ("One long sentence. " * 20).strip(), "Two is short.", ("Dense text beside the articles. " * 10).strip()
    card = "<article><a href=x>Another story to read</a></article>"
    html = f"<body><div><article><p>{one}</p><p>{one}</p></article></div><div><article><p>{two}</p></article></div>{card}<div><p>{side}</p></div><div>Short line</div></body>"
    assert main_text.main_text(html).split("\n\n") == [one, one, two, side]


def test_main_text_without_articles_keeps_other_levels():
    long, short = ("A sentence of the first part. " * 8).strip(), ("And one of the second. " * 4).strip()
    first, second = (f"<section><div>{f'<p>{t}</p>' * 5}</div></section>" for t in (long, short))
    links = "<div><a href=a>One page</a> | <a href=b>Another page</a></div>"
    html = f"<body><div><h1>Title</h1></div>{links}<div>{first}Bare text <i>between</i> the parts.{second}</div></body>"
    assert main_text.main_text(html).split("\n\n") == ["Title", *[long] * 5, "Bare text between the parts.", *[short] * 5]


def test_names_delete_no_article_text():
    body = ("Words of the article itself. " * 12).strip()
    blocks = {
        '<h2 id="related-work">': "Related work", '<h2 id="search-algorithms">': "Search algorithms", '<section id="side-effects">': "May cause sleep.", '<div class="share-prices">': "Shares rose by two.",
        '<p class="notice-period">': "Three months.", '<p title="a hidden valley">': "By the river.", '<p data-note="display: none">': "Shown.", '<div class="notice">': body,
    }
    html = "".join(f"{tag}{text}</{tag[1:].split()[0]}>" for tag, text in blocks.items())
    noise = "<div class='ad-slot'>Buy</div><div class='related-stories'><a href=x>One more</a> <a href=y>And more</a></div><p hidden>No</p><p style='color:red; display:none'>No</p><p aria-hidden=true>No</p>"
    assert main_text.main_text(f"<article><p>{body}</p>{html}{noise}<p>{body}</p></article>").split("\n\n") == [body, *blocks.values(), body]


def test_broken_tags_take_linear_time():
    for piece in ("<a x ", "<a x='", '<a "', "<", "</", "<!", "<p><b>", "<a x>", "<li>", "<td>"):
        began = time.perf_counter()
        main_text.main_text("<article><p>kept</p>" + piece * (1_000_000 // len(piece)))
        took = time.perf_counter() - began
        print(piece, took)
        assert took < 20, piece
    assert main_text.main_text("<article><p>a < b and c</p><p title='x>one</p><p>two</p></article>") == "a < b and c\n\none\n\ntwo"
    assert main_text.main_text("<article><p>whole</p><p cl") == "whole"


def test_main_text_of_odd_pages(spark):
    odd = [None, "", " ", "<", "<<>>", "</p></div>", "<p", "text only", "<a href='x'>l</a>" * 2000, "<div>" * 3000 + "deep", "&#x110000; &bogus;", "<script>never closed"]
    rows = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(odd)] + [(None, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in main_text.extract(rows).collect()}
    assert len(got) == len(odd) + 1 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[0]["text"] == got[1]["text"] == got[11]["text"] == "" and got[7]["text"] == "text only" and got[9]["text"] == "deep"
    assert main_text.extract(rows.limit(0)).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    here, columns = docs, docs.columns
    sizes = {}
    for name, step in cp.STAGES:
        before = {r["doc_id"] for r in here.select("doc_id").collect()}
        here = step(spark, here, "/root/testdata/sf0.001").cache()
        after = {r["doc_id"] for r in here.select("doc_id").collect()}
        assert after <= before
        sizes[name] = (len(before), len(after))
        if name != cp.STAGES[-1][0]:
            assert here.columns == columns
    assert sizes["language_id"][1] >= 0.97 * sizes["language_id"][0]
    assert sizes["best_fit_packing"][0] == sizes["best_fit_packing"][1]
    empty = docs.limit(0)
    for _, step in cp.STAGES:
        assert step(spark, empty, "").count() == 0


def test_language_scores_equal_brute_force(spark):
    """Every text's sum over words of log frequencies, by known words, else by the longest n-grams that are known."""
    import math

    import regex

    from sieveyard.llm import language_id

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    extra = [(9001, "Zzyzx qqqqx ünbekannt", None), (9002, "", "en"), (9003, None, "en"), (9004, "...", "de"), (9005, "the " * 5000, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, keep=["doc_id"]).collect()}
    for r in docs.collect():
        total = np.zeros(len(model.languages))
        found = regex.findall(r"\p{L}+", (r["text"] or "").lower())
        for word in found:
            if word in model.tables[0]:
                total += model.tables[0][word].astype(float)
                continue
            for n in (4, 3, 2, 1):
                own = f"<{word}>" if n > 1 else word
                grams = [model.tables[n][own[i : i + n]] for i in range(len(own) - n + 1) if own[i : i + n] in model.tables[n]]
                if grams:
                    total += np.sum(grams, axis=0).astype(float) / n
                    break
        if not found:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["lang_score"]) == ("und", 0.0)
            continue
        best = int(total.argmax())
        assert got[r["doc_id"]]["lang_pred"] == model.languages[best]
        assert math.isclose(got[r["doc_id"]]["lang_score"], 1 / np.exp(np.maximum(total - total[best], -700)).sum(), rel_tol=1e-3, abs_tol=1e-6)


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage with its production parameters on the smallest table and planted rows."""
    import duckdb
    import pyarrow as pa

    import corpus_pipeline as cp
    from sieveyard.llm import language_id, source_mix
    from tests.llm.test_documents import jaccard_components, split

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.where("length(text) > 900").orderBy("doc_id").limit(6).collect()]
    words = [t.split() for t in texts]
    planted = [
        " ".join(words[0][:-2] + ["changed", "end"]), texts[1].upper(), " ".join(words[2][:60] + words[3][10:80] + words[4][:40]), " ".join(words[5][:49]), None, "", "12 34 ?!", "\n \t",
        " ".join(words[3][10:70]), " ".join(words[4][:30] + words[0][5:64] + words[4][30:]),
    ]
    rows = [(10_000 + i, t, None if i % 2 else "en", None if i % 3 else "src1", len(t or "")) for i, t in enumerate(planted)]
    kinds = {f.name: f.dataType for f in docs.schema}
    added = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(added.select(*[added[c].cast(kinds[c]).alias(c) for c in docs.columns])).cache()
    table = lambda df: [tuple(r) for r in df.select("doc_id", "text", "source").collect()]

    kept = cp.identify_language(spark, docs, "").cache()
    named = language_id.identify(docs, language_id.fit(docs), keep=["doc_id"]).where("lang_pred <> 'und' and lang_score >= 0.5")
    assert {r[0] for r in table(kept)} == {r["doc_id"] for r in named.collect()}
    assert not {10_004, 10_005, 10_006, 10_007} & {r[0] for r in table(kept)}

    before = table(docs)
    apart = cp.drop_near_duplicates(spark, docs, "").cache()
    components = jaccard_components(before, 5)
    assert {r[0] for r in table(apart)} == {d for d, (_, c) in components.items() if c == d} and len(table(apart)) < len(before)

    cut = {d: t for d, t, _ in table(cp.drop_repeated_passages(spark, docs, ""))}
    first, gone_in = {}, {}
    for d, t, _ in sorted(before, key=lambda r: r[0]):
        w = split(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), (d, i))
    changed = 0
    for d, t, _ in before:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] != (d, i):
                gone[i : i + 50] = [True] * 50
        if any(gone):
            changed += 1
            left = b" ".join(x for x, g in zip(w, gone) if not g).decode()
            assert cut.get(d, "") == left and (d in cut) == bool(left)
        else:
            assert cut[d] == t
    assert changed

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in before], "source": [r[2] for r in before]}))
    want = con.execute(source_mix.ORACLE.format(period=2048, block=16, minor=0.1)).fetchall()
    assert {r[0] for r in table(cp.mix(spark, docs, ""))} == {r[0] for r in want if r[4]}

    bins = {}
    for r in cp.pack_sequences(spark, docs, "").collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["doc_id"]))
    assert {d for parts in bins.values() for _, _, d in parts} == {r[0] for r in before}
    for parts in bins.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
