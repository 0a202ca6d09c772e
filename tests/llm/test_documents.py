"""Operators on documents against brute force, with null, empty, long, repeated and clashing input."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sieveyard.llm import class_lm, language_id, near_duplicates, packing, source_mix, substring_duplicates, token_counts

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h1 string, rep string, key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 40, n)))


def corpus():
    base, other = prose(1, 120), prose(2, 90)
    edited = base.split()
    edited[7] = "changed"
    texts = [
        base, base, base.upper(), " ".join(edited), other, other + " " + prose(3, 8), None, "", " \t\n", "one", "one", "two words", "a b c d", prose(4, 60) + " " + " ".join(base.split()[30:80]),
        prose(5, 4000), "é è ²½ <|endoftext|> 'll  x", "der die das und nicht ist", "the and of to in is", prose(6, 19), prose(6, 20), prose(6, 20) + " " + prose(6, 20), "12345 ... ,,,",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[min(i % 5, 2)], len(t or ""), "x", "y", "z", "k") for i, t in enumerate(texts)]
    return [*rows, (3, " ".join(edited), "en", "s1", 1, "x", "y", "z", "k"), (None, prose(9, 30), "en", "s1", 1, "x", "y", "z", "k")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text, lower=False):
    data = (text or "").encode()
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", data.translate(LOWER) if lower else data) if w]


def test_token_counts_match_the_library(docs, none):
    tk = Tokenizer.from_file(BYTE_BPE)
    got = {(r["doc_id"], r["n_bytes"]): r for r in token_counts.token_counts(docs, BYTE_BPE, limit=16).collect()}
    for doc, text, *_ in corpus():
        text = text or ""
        n = len(tk.encode(text, add_special_tokens=False).ids)
        r = got[doc, len(text.encode())]
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 16)
        assert len(tk.encode(text[: r["fit_chars"]], add_special_tokens=False).ids) <= 16
    assert token_counts.token_counts(none, BYTE_BPE).count() == 0


def test_every_prefix_is_counted():
    tk, counter = Tokenizer.from_file(BYTE_BPE), token_counts.PrefixCounter(BYTE_BPE)
    rng = np.random.default_rng(12)
    parts = ["a", "word", " ", "  ", "\n", "\n\n\n", "'re", "'", "'s", "??", "<|", "<|endoftext|>", "é", "你", "12", "\t", "…", "'x", "\u00a0", "\x1d", "_"]
    mixed = ["".join(parts[i] for i in rng.integers(0, len(parts), 14)) for _ in range(60)]
    for text in ("a  b\n\n c's <|endoftext|>  we'll ²½ 你好", "  <|endoftext|><|endoftext|> x", "hello   world\t\n 12 345", "?!?!<|endoftext|>", *mixed):
        counts = token_counts.PrefixCounts(counter, text)
        want = [len(tk.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert [counts.at(p) for p in range(len(text) + 1)] == want, text
        for budget in range(counts.total() + 2):
            reach = max(p for p in range(len(text) + 1) if want[p] <= budget)
            assert counts.reach(budget) == token_counts.PrefixCounts(counter, text, budget).reach(budget) == reach, (text, budget)


def test_one_word_of_a_million_letters():
    counter = token_counts.PrefixCounter(BYTE_BPE)
    text = "".join(map(chr, np.random.default_rng(3).integers(97, 123, 1_000_000)))
    began = time.perf_counter()
    counts = token_counts.PrefixCounts(counter, text)
    reach = counts.reach(512)
    assert time.perf_counter() - began < 30 and counter.count(text[:reach]) == 512 and counts.at(reach + 1) > 512
    assert counts.total() == len(Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids)


def test_new_words_take_few_lookups():
    counter = token_counts.PrefixCounter(BYTE_BPE)

    class Looked(dict):
        times = 0

        def get(self, *key):
            Looked.times += 1
            return super().get(*key)

    counter.vocab = Looked(counter.vocab)
    rng = np.random.default_rng(3)
    parts = ["th", "er", "on", "an", "tion", "ing", "ble", "ou"]
    text = " ".join("".join(parts[i] for i in rng.integers(0, len(parts), 2 + k % 5)) for k in range(2000))
    assert counter.count(text) == len(Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids)
    assert Looked.times < 2 * len(text)  # 3.5 a byte where each prefix of each word is worked out anew


def test_count_and_reach_equal_the_library():
    tk, counter = Tokenizer.from_file(BYTE_BPE), token_counts.PrefixCounter(BYTE_BPE)
    rng = np.random.default_rng(21)
    parts = ["a", "word", "inthhalyor", " ", " ", " ", "  ", "\n", ".", ",", "'re", "??", "<|endoftext|>", "é", "Ωμέγα", "你", "12", "²", "\x1c"]
    mixed = ["".join(parts[i] for i in rng.integers(0, len(parts), 12)) for _ in range(120)]
    for text in ("", " ", "one", "a. b, c! d", "word" * 100 + " " + "ab" * 40 + ".", " lead and trail ", *mixed):
        n = [len(tk.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        for budget in range(0, n[-1] + 2, 1 + n[-1] // 12):
            assert counter.count_and_reach(text, budget) == (n[-1], max(p for p, k in enumerate(n) if k <= budget)), (text, budget)


def test_pack_places_every_piece_without_gaps(docs, none):
    tk = Tokenizer.from_file(WORD_BPE)
    got = packing.pack(docs, WORD_BPE, capacity=64).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = 0
    for doc, text, *_ in {r[0]: r for r in corpus()}.values():
        ids = np.array([*tk.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        rows = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc]})
        assert [r[2] for r in rows] == [len(ids[a : a + 64]) for a in range(0, len(ids), 64)]
        assert all(crc == zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, crc in rows)
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 64) + 1
    assert packing.pack(none, WORD_BPE).count() == 0


def test_word_ids_equal_the_library_and_are_kept_once():
    tk, words = Tokenizer.from_file(WORD_BPE), packing.WordIds(WORD_BPE)
    library = lambda text: np.array(tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    new = [f"{w}{v}" for w in WORDS for v in ("ab", "onth", "ering")]
    text = " ".join(f"{w} {w}, {w.title()}." for w in new)
    assert words.ids(text) == library(text)
    held = sum(len(d) for d in (words, *vars(words).values()) if isinstance(d, dict) and any(w in d for w in new))
    assert held <= 3 * len(new) + 2  # a word, the word with either mark, and the marks; not each word in a second cache
    rng = np.random.default_rng(8)
    parts = ["word", "inthhalyor", ".", ",", "!", "'s", "'", "``", "É", "straße", "Ωμέγας", "你", "1", "²", "\x01", "\x1c", "\x7f", "_", " ", " ", "\n", "<|endoftext|>", "e\u0301"]
    few = packing.WordIds(WORD_BPE, most=9)
    for _ in range(400):
        text = "".join(parts[i] for i in rng.integers(0, len(parts), 12))
        assert words.ids(text) == few.ids(text) == library(text), text


def test_word_ids_of_unassigned_characters():
    tk, words = Tokenizer.from_file(WORD_BPE), packing.WordIds(WORD_BPE)
    for c in (0x558, 0x58B, 0x88F, 0x1C89, 0xA7DC, 0x107BB, 0xE000, 0x1FFFE):
        text = f"a{chr(c)}b, {chr(c)}. {chr(c)}1"
        assert words.ids(text) == np.array(tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), hex(c)


def test_plan_is_never_worse_than_best_fit():
    rng = np.random.default_rng(5)
    for scale, top in ((50, 2048), (2000, 700), (3000, 1400)):
        histogram = Counter(rng.integers(1, top, scale).tolist())
        places, n = packing.plan(histogram, 2048)
        assert n <= packing.plan(histogram, 2048, rounds=1, rounding=0.0)[1]
        load = Counter()
        seen = Counter()
        for p in places:
            seen[p.length] += p.count
            for k in range(p.count):
                load[p.sequence + k // p.per] += p.length
        assert seen == histogram and max(load.values()) <= 2048 and len(load) == n


def jaccard_components(rows, k):
    sets = {}
    for doc, text, *_ in rows:
        w = split(text, lower=True)
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_equal_brute_force(docs, none):
    want = jaccard_components(corpus(), 4)
    got = near_duplicates.near_duplicates(docs, k=4).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    assert near_duplicates.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_dense_group(spark):
    """Copies of one text with one to twelve changes: some link with the first, some through others, some not at all."""
    rng = np.random.default_rng(3)
    base = prose(20, 100).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        w = list(base)
        for at in rng.choice(100, rng.integers(1, 13), replace=False):
            w[at] = f"new{rng.integers(0, 400)}"
        rows.append((i, " ".join(w)))
    want = jaccard_components(rows, 4)
    assert len({c for _, c in want.values()}) > 3
    for options in ({}, {"tile_docs": 16}, {"tile_shingles": 2000}):
        got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4, **options).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_near_duplicates_in_a_group_of_thousands(spark):
    """5,000 near copies in chains: each block of 50 is linked with its neighbours only, the first and the last with nothing in common."""
    rng = np.random.default_rng(8)
    text, rows = prose(30, 140).split(), []
    for i in range(5000):
        if i % 50 == 0:
            for at in rng.choice(140, 2, replace=False):
                text[at] = f"step{i}"
        w = list(text)
        w[int(rng.integers(0, 140))] = f"own{i}"
        rows.append((i, " ".join(w)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=4).collect()
    assert len(got) == 5000 and {r["component_id"] for r in got} == {0}


def test_overlaps_equal_set_intersections():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, top, n).astype(np.uint64)) for top, n in [(40, 30)] * 20 + [(4000, 200)] * 10 + [(1, 0)] * 2]
    a, b = np.arange(0, 32, 3), np.arange(32)
    for wide in (1, 4, 24):
        got = near_duplicates.overlaps(sets, a, b, wide=wide, step=16)
        assert all(got[i, j] == (0 if x == y else len(np.intersect1d(sets[x], sets[y]))) for i, x in enumerate(a) for j, y in enumerate(b))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 900, dtype=np.uint64), rng.integers(0, 2**63, 900, dtype=np.uint64)
    b[:700] = a[:700]
    one = lambda h: near_duplicates.registers(near_duplicates.minima(np.zeros(len(h), np.int64), h, 1))
    assert (near_duplicates.merge(one(a), one(b)) == one(np.union1d(a, b))).all()
    true = 700 / 1100
    greater, smaller = (one(a) > one(b)).sum(axis=1), (one(a) < one(b)).sum(axis=1)
    grid = np.linspace(0, 1, 101)
    best = grid[int(np.argmax([near_duplicates.log_likelihood(greater, smaller, np.array([900.0]), np.array([900.0]), np.array([g]))[0] for g in grid]))]
    assert abs(best - true) < 0.2


def test_language_of_words_and_endings(docs, none):
    model = language_id.fit(docs)
    got = language_id.identify(docs, model, keep=["doc_id"]).collect()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (6, 7, 8, 21)) for r in got)
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    assert language_id.fit(none).languages == ()
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(none)).collect()} == {"und"}


def test_language_on_held_out_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(rows, train=~held)
    right = language_id.identify(rows.where(held), model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_language_backs_off_to_shorter_grams():
    table = [{"known": np.array([1.0, -1.0], np.float32)}, {"a": np.array([0.5, -0.5], np.float32)}, {"ab": np.array([-2.0, 2.0], np.float32)}, {"abc": np.array([3.0, -3.0], np.float32)}]
    model = language_id.LanguageModel(("x", "y"), tuple(table))
    assert model.score("known")[0] == 1 and model.score("zabc")[0] == 1 and model.score("zabz")[1] == 1 and model.score("za")[0] == 0.5 and not model.score("q").any()


def test_class_model_and_base_score(docs, none, spark):
    from pyspark.sql import functions as F

    train = F.coalesce(F.col("doc_id") % 4 != 0, F.lit(True))
    got = class_lm.class_lm(docs, train=train, classes=6).collect()
    texts = [(d, [*split(t, lower=True), None]) for d, t, *_ in corpus()]
    counts = Counter(w for d, ws in texts if d is None or d % 4 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if d is None else d, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in texts)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert class_lm.class_lm(none, train=F.lit(True)).count() == 0
    untaught = class_lm.class_lm(docs, train=F.lit(False), classes=4).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["base_score"]) < 1e-9 for r in untaught)


def test_one_class_scores_as_the_base(docs):
    """With a single class transitions say nothing and the emission is the base's, of frequent and of rare words alike."""
    from pyspark.sql import functions as F

    for frequent in (65_536, 20, 0):
        for r in class_lm.class_lm(docs, train=F.coalesce(F.col("doc_id") % 4 != 0, F.lit(True)), classes=1, frequent=frequent).collect():
            assert abs(r["score"] - r["base_score"]) < 1e-6


def test_exchange_of_all_words_equals_trying_each():
    rng = np.random.default_rng(4)
    left, right = rng.integers(0, 9, (30, 5)).astype(float), rng.integers(0, 9, (30, 5)).astype(float)
    counts, of, table = left.sum(axis=1), rng.integers(0, 5, 30), rng.integers(300, 900, (5, 5)).astype(float)
    got = class_lm.exchange_all(left, right, counts, of, table)
    into = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 2.5)
    for w in range(30):
        gains = []
        for c in range(5):
            others = table[:, c].sum() - (counts[w] if c == of[w] else 0)
            gains.append(sum(left[w, a] * math.log(into[a, c]) + right[w, a] * math.log(into[c, a]) for a in range(5)) - counts[w] * math.log(others + counts[w] + 0.1))
        assert got[w] == int(np.argmax(gains))


def test_words_in_context_join_the_right_class(spark):
    """Numbers follow 'take', colours follow 'paint': a held-out text with the right kinds is likelier than with wrong ones."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    ones, twos = [f"n{i}x" for i in range(30)], [f"c{i}x" for i in range(30)]
    rows = [(i, " ".join(f"take {ones[a]} paint {twos[b]}" for a, b in rng.integers(0, 30, (40, 2)))) for i in range(60)]
    rows += [(1000, f"take {ones[3]} paint {twos[4]}"), (1001, f"take {twos[4]} paint {ones[3]}")]
    got = {r["doc_id"]: r["score"] for r in class_lm.class_lm(spark.createDataFrame(rows, "doc_id long, text string"), train=F.col("doc_id") < 1000, classes=5, own_types=4, ending_types=2).collect()}
    assert got[1000] > got[1001] + 1


def test_exchange_parts_alternating_types():
    pairs = np.zeros((6, 6))
    for a in (0, 2, 4):
        for b in (1, 3, 5):
            pairs[a, b] = pairs[b, a] = 50
    of = class_lm.exchange(pairs, 2)
    assert of[0] == of[2] == of[4] != of[1] == of[3] == of[5]


def test_repeated_windows_go(docs, none):
    rows = sorted({(1 << 62 if d is None else d, t) for d, t, *_ in corpus()}, key=lambda r: r[0])
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    want = {}
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (d, i):
                gone[i : i + 20] = [True] * 20
        want[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    got = substring_duplicates.remove_repeats(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        d = 1 << 62 if r["doc_id"] is None else r["doc_id"]
        assert (r["n_words"], r["n_removed"], hashlib.sha256(r["text"].encode()).hexdigest()) == want[d]
    assert any(r["n_removed"] for r in got)
    assert substring_duplicates.remove_repeats(none).count() == 0


def test_count_min_never_undercounts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    own = substring_duplicates.CountMin(12, 2)  # far too small: false alarms, no misses
    own.add(h)
    own.add(h[:100])
    for key, once, more in own.segments():
        assert not set(substring_duplicates.unpack(once)) & set(substring_duplicates.unpack(more))
    for _, positions in ((0, np.array([], np.int64)), (1, np.array([0, 5, 70000]))):
        assert (substring_duplicates.unpack(substring_duplicates.pack(positions)) == positions).all()


def test_mix_stays_within_a_block(spark, none):
    rng = np.random.default_rng(2)
    rows = [(i, ("big", "mid", "small", None)[int(np.searchsorted([0.7, 0.9, 0.97], rng.random()))]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"big": 0.25, "mid": 0.5, "small": 0.25}
    got = source_mix.mix_sources(docs, weights, block_rows=4, period=64).collect()
    assert len(got) == 4000 and all(r["slot"] is None for r in got if r["source"] is None)
    kept = sorted({(r["slot"], r["source"]) for r in got if r["kept"]})
    assert [s for s, _ in kept] == list(range(len(kept)))  # a slot each, none empty
    seen = Counter()
    for slot, source in kept:
        seen[source] += 1
        for s, w in weights.items():
            assert abs(seen[s] - (slot + 1) * round(w * 64) / 64) < 1.2  # less than one block, and the rounding of weights
    taken = source_mix.take_mix(docs, weights=weights, block_rows=4, period=64)
    assert {r["doc_id"] for r in taken.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert source_mix.mix_sources(none).count() == 0
    null_ids = spark.createDataFrame([(None, None), (None, None), (1, "a")], "doc_id long, source string")
    assert source_mix.mix_sources(null_ids).count() == 3


def test_mix_keeps_every_row_of_equal_sources(spark):
    for n_sources, each in ((20, 10), (17, 10), (20, 500)):
        docs = spark.createDataFrame([(i, f"s{i % n_sources}") for i in range(n_sources * each)], "doc_id long, source string")
        assert source_mix.take_mix(docs).count() == n_sources * each


def test_mix_of_skewed_sources_meets_its_weights(spark):
    """At production parameters, 100 : 10 : 1, and a stray row that must not end the mix."""
    sizes = {"large": 20_000, "middle": 2_000, "small": 200, None: 1}
    docs = spark.createDataFrame([(s * 100_000 + i, k) for s, (k, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, source string")
    rows = source_mix.mix_sources(docs).collect()
    kept = [r for r in rows if r["kept"]]
    roots = {k: math.floor(math.sqrt(n) * 1000) for k, n in sizes.items()}
    got, blocks = Counter(r["source"] for r in kept), {k: len({r["block"] for r in kept if r["source"] == k}) for k in sizes}
    assert len(rows) == sum(sizes.values()) and got["small"] == 200 and got[None] == 1
    slots = max(r["slot"] for r in kept) + 1
    for k in ("large", "middle", "small"):
        assert abs(blocks[k] - slots * roots[k] / sum(roots.values())) < 1 + slots / 2048  # a block, and the rounding to whole slots
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r["doc_id"] for r in rows], "source": [r["source"] for r in rows]}))
    want = con.execute(source_mix.ORACLE.format(period=2048, block=16, minor=0.1)).fetchall()
    assert {(r["doc_id"], r["source"], r["block"], r["slot"], r["kept"]) for r in rows} == set(want)


def test_mix_raises_for_too_many_sources(spark):
    docs = spark.createDataFrame([(i, f"s{i}", "b", "s", "k") for i in range(40)], "doc_id long, source string, block string, slot string, kept string")
    with pytest.raises(Exception, match="too short"):
        source_mix.mix_sources(docs.drop("block", "slot", "kept"), period=64).collect()
    got = source_mix.mix_sources(docs, period=128)
    assert got.columns == ["doc_id", "source", "block", "slot", "kept"] and got.where("kept").count() == 40
