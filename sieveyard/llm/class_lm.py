"""Brown class-based n-grams.

Exchange clustering moves word types between classes while that raises the likelihood of class bigrams.  It begins with the most
frequent words and, for all other words, their endings, so that every word, seen or not, has a class.  Then all words of the
broadcast table are exchanged at once, each by the classes of its own neighbours.  A
text's probability is the product of class transitions and of words given their class, both smoothed.

Counts of all words come from all training texts.  Words are 64-bit hashes here; counts travel in buckets of
the hash.  A bounded table of frequent words is broadcast; a rare word's count is asked for from its bucket.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveyard.llm.hashing import LOWER, U, Words, buffers, chunks
from sieveyard.llm.staging import stage

FLUSH = 6_000_000
#: Stands for the end of a text among word hashes.
END = U(0x5EED0E2D0F7E8711)
FLOOR, TRANSITION_FLOOR = 0.1, 0.5


def endings(words: Words) -> np.ndarray:
    """Each word's last two bytes, A-Z lower-cased, as one number; a word of one byte has no first."""
    last = LOWER[words.data[words.end - 1]].astype(np.int64)
    two = words.end - words.start > 1
    return last | np.where(two, LOWER[words.data[np.maximum(words.end - 2, 0)]].astype(np.int64), 0) << 8


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zlib.decompress(blob)
    n, out, at = len(data) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _summed(h: np.ndarray, count: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, count, ending = h[order], count[order], ending[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[at], np.add.reduceat(count, at) if len(at) else count, ending[at]


def magnitude(count: np.ndarray) -> np.ndarray:
    """Which eighth of a power of two."""
    return np.floor(8 * np.log2(np.maximum(count, 1))).astype(np.int64)


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 6) -> np.ndarray:
    """The class of each type.  ``bigrams[i, j]`` counts type j after type i.

    A type goes to the class that raises sum n log n over class bigrams less that over left and right class counts the most.
    """
    n = len(bigrams)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    order = np.argsort(-weight, kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.minimum(np.arange(n), classes - 1) if n <= classes else np.arange(n) % classes
    one = np.zeros((n, classes))
    one[np.arange(n), of] = 1
    into, out = bigrams.T @ one, bigrams @ one  # before and after each type, by class
    table = one.T @ bigrams @ one
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    for _ in range(rounds):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a, own = of[w], bigrams[w, w]
            before, after = into[w].copy(), out[w].copy()
            before[a] -= own
            after[a] -= own
            # take w out of its class
            table[:, a] -= before
            table[a, :] -= after
            table[a, a] -= own
            left, right = table.sum(axis=1), table.sum(axis=0)
            total_out, total_in = after.sum() + own, before.sum() + own
            cols = f(table + before[:, None]).sum(axis=0) - f(table).sum(axis=0)
            rows = f(table + after[None, :]).sum(axis=1) - f(table).sum(axis=1)
            d = np.diag(table)
            both = f(d + before + after + own) - f(d + before) - f(d + after) + f(d)
            gain = cols + rows + both - (f(left + before + total_out) - f(left + before)) - (f(right + after + total_in) - f(right + after))
            # the other classes' totals change alike wherever w goes, but for the class itself
            k = int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else a
            table[:, k] += before
            table[k, :] += after
            table[k, k] += own
            if k != a:
                moved += 1
                of[w] = k
                into[:, a] -= bigrams[w, :]
                into[:, k] += bigrams[w, :]
                out[:, a] -= bigrams[:, w]
                out[:, k] += bigrams[:, w]
        if not moved:
            break
    return of


class Model:
    """``frequent``: sorted hashes with ``counts`` and ``types``; ``by_ending``: the type of other words."""

    def __init__(self, frequent, counts, types, by_ending, end_type, end_count, tokens, distinct):
        self.key = uuid.uuid4().int
        self.frequent, self.counts, self.types, self.by_ending = frequent, counts, types, by_ending
        self.end_type, self.end_count, self.tokens, self.distinct = end_type, end_count, tokens, distinct
        self.of = self.own_class = self.transition = self.emission = None

    def look_up(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Types, and counts of frequent words (-1 for others)."""
        if not len(self.frequent):
            return self.by_ending[ending], np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        known = self.frequent[at] == h
        types = np.where(known & (self.types[at] >= 0), self.types[at], self.by_ending[ending])
        return types, np.where(known, self.counts[at], -1)


    def class_of(self, h: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes, counts of frequent words (-1 for others) and their numbers in the table."""
        if not len(self.frequent):
            return self.of[self.by_ending[ending]], np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
        known = self.frequent[at] == h
        return np.where(known, self.own_class[at], self.of[self.by_ending[ending]]), np.where(known, self.counts[at], -1), at


def exchange_all(left: np.ndarray, right: np.ndarray, counts: np.ndarray, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The best class of each word, the others staying where they are.

    ``left[w, c]`` and ``right[w, c]`` count classes before and after word w; ``table`` counts class bigrams.  The gain of a class is that of the transitions
    into and out of it, less the share that the word's tokens have in the class.
    """
    classes = len(table)
    log = np.log((table + TRANSITION_FLOOR) / (table.sum(axis=1, keepdims=True) + TRANSITION_FLOOR * classes))
    size = np.maximum(table.sum(axis=0)[None, :] - np.where(np.arange(classes) == of[:, None], counts[:, None], 0), 0) + counts[:, None] + FLOOR
    return np.argmax(left @ log + right @ log.T - counts[:, None] * np.log(size), axis=1)


def sequences(words: Words, types: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbouring types with their text's number; each text has the end before and after it."""
    n, size = words.n, np.diff(words.first)
    first = np.cumsum(size + 1) - (size + 1)  # places of the texts in a row of words and ends
    row = np.full(len(types) + n, end, np.int64)
    row[np.arange(len(types)) + words.doc] = types
    before = np.empty_like(row)
    before[1:] = row[:-1]
    before[first] = end
    return before, row, np.repeat(np.arange(n), size + 1)


def class_lm(docs: DataFrame, train: Column, classes: int = 48, own_types: int = 512, ending_types: int = 256, frequent: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Words have A-Z lower-cased; each text ends in an end token that counts.  ``train`` says which rows are learnt from (null: not).
    ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))), ``score`` is the class model's log10 probability, ``n_known`` the tokens with
    c > 0.  In a class a word has (c + 0.1) / (class tokens + 0.1 (class words + 1)): the last share is that of unknown words.

    Null and empty texts consist of the end token.  Repeated rows are texts of their own, null ids pass, ids are integers, other columns are
    ignored.  Without a training row all counts are 0.

    What reaches the driver or all executors is bounded: at most ``frequent`` words with exact counts, those above a count that depends on the corpus,
    with ``2 * classes`` numbers each, and (``own_types`` + ``ending_types``)**2 bigram counts.  All else moves in buckets of the hash, and texts are never shuffled.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])
    buckets = max(256, size >> 27)

    def learnt(batches):
        """Words of the training texts, with their endings, a stretch of texts at a time."""
        for batch in batches:
            batch = batch.filter(batch.column(2))
            data, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets):
                words = Words(data, offsets[i : j + 1], lower=True)
                yield words, endings(words)

    def count(batches):
        held: list[tuple] = []
        waiting, ends, tails = 0, 0, np.zeros(65_536, np.int64)

        def flush():
            h, c, e = _summed(*(np.concatenate(x) for x in zip(*held))) if held else _summed(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint16))
            held.clear()
            bucket = buckets_of(h, buckets)
            cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h))
            blobs = [_pack(h[a:b], c[a:b].astype(np.uint32), e[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "words"])

        for words, tail in learnt(batches):
            ends += words.n
            tails += np.bincount(tail, minlength=65_536)
            h, c, e = _summed(words.hash, np.ones(len(tail), np.int64), tail.astype(np.uint16))
            held.append((h, c, e))
            waiting += len(h)
            if waiting > FLUSH:
                yield flush()
                waiting = 0
        yield flush()
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array([-1 - part], pa.int64()), pa.array([_pack(np.append(tails, ends))], pa.binary())], names=["bucket", "words"])

    def merge(t: pa.Table) -> pa.Table:
        """A bucket's vocabulary, and how many of its words have which power of two as their count, in eighths; buckets under 0 hold the counts of endings and of texts."""
        bucket = t.column("bucket")[0].as_py()
        if bucket < 0:
            total = np.sum([_unpack(b.as_py(), "i8")[0] for b in t.column("words")], axis=0)
            return pa.table({"bucket": pa.array([bucket], pa.int64()), "words": pa.array([_pack(total)], pa.binary()), "tokens": pa.array([0], pa.int64()), "distinct": pa.array([0], pa.int64()), "histogram": pa.array([b""], pa.binary())})
        parts = [_unpack(b.as_py(), "u8", "u4", "u2") for b in t.column("words")]
        h, c, e = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64), np.concatenate([p[2] for p in parts]))
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "words": pa.array([_pack(h, c, e)], pa.binary()), "tokens": pa.array([int(c.sum())], pa.int64()), "distinct": pa.array([len(h)], pa.int64()), "histogram": pa.array([_pack(np.bincount(magnitude(c), minlength=512))], pa.binary())})

    counted = rows.mapInArrow(count, "bucket long, words binary").groupBy("bucket").applyInArrow(merge, "bucket long, words binary, tokens long, distinct long, histogram binary")
    vocabulary = stage(counted, "vocabulary")
    total = vocabulary.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    blobs = lambda name, which: [x.as_py() for x in vocabulary.where(which).select(name).toArrow().column(name)]
    tails = sum((_unpack(b, "i8")[0] for b in blobs("words", "bucket < 0")), np.zeros(65_537, np.int64))  # 64 at most
    ends = int(tails[-1])

    def added_up(batches):
        total = np.zeros(512, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += _unpack(blob.as_py(), "i8")[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(512)), pa.array(total)], names=["magnitude", "n"])

    sums = vocabulary.where("bucket >= 0").select("histogram").mapInArrow(added_up, "magnitude long, n long").groupBy("magnitude").agg(F.sum("n").alias("n")).collect()
    histogram = np.zeros(512, np.int64)
    for r in sums:
        histogram[r["magnitude"]] = r["n"]
    above = np.append(np.cumsum(histogram[::-1])[::-1], 0)
    least = int(np.flatnonzero(above <= frequent)[0])

    def commonest(batches):
        for batch in batches:
            for blob in batch.column(0):
                h, c, e = _unpack(blob.as_py(), "u8", "i8", "u2")
                on = magnitude(c) >= least
                yield pa.RecordBatch.from_arrays([pa.array(h[on].view(np.int64)), pa.array(c[on]), pa.array(e[on].astype(np.int32))], names=["h", "n", "ending"])

    top = vocabulary.where("bucket >= 0").select("words").mapInArrow(commonest, "h long, n long, ending int").toArrow()
    words_, counts_, endings_ = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy(), top.column("ending").to_numpy()
    order = np.argsort(words_)
    words_, counts_, endings_ = words_[order], counts_[order], endings_[order]
    types = np.full(len(words_), -1, np.int64)
    own = np.argsort(-counts_, kind="stable")[:own_types]
    types[own] = np.arange(len(own))
    by_ending = np.full(65_536, own_types + ending_types, np.int64)
    tail_order = np.argsort(-tails[:-1], kind="stable")[:ending_types]
    by_ending[tail_order] = own_types + np.arange(ending_types)
    all_types = own_types + ending_types + 2
    model = Model(words_, counts_, types, by_ending, all_types - 1, ends, int(total["n"]) + ends, int(total["v"]) + (ends > 0))
    plain = spark.sparkContext.broadcast(model)

    def pairs(batches):
        m, seen = plain.value, np.zeros(all_types * all_types, np.int64)
        for words, tail in learnt(batches):
            before, after, _ = sequences(words, m.look_up(words.hash, tail)[0], m.end_type)
            seen += np.bincount(before * all_types + after, minlength=len(seen))
        at = np.flatnonzero(seen)
        share = at // all_types % 64
        for k in np.unique(share):
            on = at[share == k]
            yield pa.RecordBatch.from_arrays([pa.array([int(k)]), pa.array([_pack(on, seen[on])], pa.binary())], names=["share", "pairs"])

    def added(t: pa.Table) -> pa.Table:
        parts = [_unpack(b.as_py(), "i8", "i8") for b in t.column("pairs")]
        sums = np.bincount(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        at = np.flatnonzero(sums)
        return pa.table({"pairs": pa.array([_pack(at, sums[at].astype(np.int64))], pa.binary())})

    bigrams = np.zeros(all_types * all_types)
    for x in rows.mapInArrow(pairs, "share long, pairs binary").groupBy("share").applyInArrow(added, "pairs binary").toArrow().column("pairs"):
        at, n = _unpack(x.as_py(), "i8", "i8")
        bigrams[at] = n
    bigrams = bigrams.reshape(all_types, all_types)
    of = exchange(bigrams, classes)
    one = np.zeros((all_types, classes))
    one[np.arange(all_types), of] = 1
    table = one.T @ bigrams @ one
    model.of, end_class = of, int(of[-1])
    model.own_class = of[np.where(types >= 0, types, by_ending[endings_])]
    grouped = spark.sparkContext.broadcast(model)

    def classes_of(m, words, tail):
        c, n, at = m.class_of(words.hash, tail)
        before, row, _ = sequences(words, c, end_class)
        return before, row, n, at

    def neighbours(batches):
        """Classes before and after the words of the table."""
        m, seen = grouped.value, np.zeros((2, len(words_) * classes), np.int64)
        for words, tail in learnt(batches):
            before, row, n, at = classes_of(m, words, tail)
            known = np.flatnonzero(n >= 0)
            place = known + words.doc[known]  # in the row of words and ends
            seen[0] += np.bincount(at[known] * classes + before[place], minlength=seen.shape[1])
            seen[1] += np.bincount(at[known] * classes + row[place + 1], minlength=seen.shape[1])
        for side in (0, 1):
            on = np.flatnonzero(seen[side])
            share = on // classes % 64
            for k in np.unique(share):
                part = on[share == k]
                yield pa.RecordBatch.from_arrays([pa.array([int(k) + 64 * side]), pa.array([_pack(part, seen[side][part])], pa.binary())], names=["share", "pairs"])

    def added_with_side(t: pa.Table) -> pa.Table:
        return added(t).append_column("side", pa.array([t.column("share")[0].as_py() // 64], pa.int64())).select(["side", "pairs"])

    sides = np.zeros((2, len(words_) * classes), np.float32)
    if len(words_):
        met = rows.mapInArrow(neighbours, "share long, pairs binary").groupBy("share").applyInArrow(added_with_side, "side long, pairs binary").toArrow()
        for side, x in zip(met.column("side").to_pylist(), met.column("pairs")):
            at, n = _unpack(x.as_py(), "i8", "i8")
            sides[side][at] = n
        left, right = sides.reshape(2, len(words_), classes)
        model.own_class = exchange_all(left, right, counts_.astype(float), model.own_class, table)
        grouped = spark.sparkContext.broadcast(model)

    def class_pairs(batches):
        m, seen = grouped.value, np.zeros(classes * classes, np.int64)
        for words, tail in learnt(batches):
            before, row, _, _ = classes_of(m, words, tail)
            seen += np.bincount(before * classes + row, minlength=len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(seen))), pa.array(seen)], names=["pair", "n"])

    if len(words_):
        table = np.zeros(classes * classes)
        for r in rows.mapInArrow(class_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
            table[r["pair"]] = r["n"]
        table = table.reshape(classes, classes)
    model.transition = np.log10((table + TRANSITION_FLOOR) / (table.sum(axis=1, keepdims=True) + TRANSITION_FLOOR * classes))
    classed = spark.sparkContext.broadcast(model)

    def shares(batches):
        m = classed.value
        tokens, distinct = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                h, c, e = _unpack(blob.as_py(), "u8", "i8", "u2")
                k = m.class_of(h, e.astype(np.int64))[0]
                tokens += np.bincount(k, c, classes).astype(np.int64)
                distinct += np.bincount(k, minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(tokens), pa.array(distinct)], names=["class", "tokens", "distinct"])

    share = vocabulary.where("bucket >= 0").select("words").mapInArrow(shares, "class long, tokens long, distinct long").groupBy("class").agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).collect()
    n_class, v_class = np.zeros(classes), np.zeros(classes)
    for r in share:
        n_class[r["class"]], v_class[r["class"]] = r["n"], r["v"]
    n_class[of[-1]] += ends
    v_class[of[-1]] += ends > 0
    model.emission = np.log10(n_class + FLOOR * (v_class + 1))
    model.key = uuid.uuid4().int
    full = spark.sparkContext.broadcast(model)

    def score(batches):
        """All that a text's words say without the counts of rare ones, whose hashes follow."""
        m, part, serial = full.value, TaskContext.get().partitionId(), 0
        end_log = np.log10(m.end_count + FLOOR)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets, 6_000_000):
                words = Words(data, offsets[i : j + 1], lower=True)
                n = words.n
                kinds, c = m.class_of(words.hash, endings(words))[:2] if len(words.hash) else (np.empty(0, np.int64), np.empty(0, np.int64))
                before, after, doc = sequences(words, kinds, end_class)
                model_part = np.bincount(doc, m.transition[before, after] - m.emission[after], n)
                common = c >= 0
                at = words.doc[common]
                logs = np.bincount(at, np.log10(c[common] + FLOOR), n) + end_log
                rare = words.hash[~common]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part << 32 | serial], pa.int64()),
                        *(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x) for x in (
                            batch.column(0).slice(i, n), batch.column(2).slice(i, n), pa.array(np.diff(words.first) + 1), pa.array(np.bincount(at, minlength=n) + (m.end_count > 0)),
                            pa.array(logs), pa.array(model_part), pa.array(np.bincount(words.doc[~common], minlength=n)),
                        )),
                        pa.array([rare.tobytes()], pa.binary()),
                    ],
                    names=["chunk", "id", "train", "n_tokens", "known", "logs", "part", "rare_n", "rare"],
                )
                serial += 1

    chunked = stage(rows.mapInArrow(score, f"chunk long, id array<{kind}>, train array<boolean>, n_tokens array<long>, known array<long>, logs array<double>, part array<double>, rare_n array<long>, rare binary"), "chunks")

    def ask(batches):
        for batch in batches:
            for chunk, rare in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = np.sort(np.frombuffer(rare.as_py(), np.uint64))
                bucket = buckets_of(h, buckets)
                cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]]), pa.array(np.full(len(cut) - 1, chunk)), pa.array([h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["bucket", "chunk", "asked"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
        h, c = _unpack(right.column("words")[0].as_py(), "u8", "i8", "u2")[:2] if right.num_rows else (np.empty(0, np.uint64), np.empty(0, np.int64))
        out = []
        for asked in left.column("asked"):
            q = np.frombuffer(asked.as_py(), np.uint64)
            got = np.zeros(len(q), np.int64)
            if len(h):
                at = np.minimum(np.searchsorted(h, q), len(h) - 1)
                got = np.where(h[at] == q, c[at], 0)
            out.append(_pack(got))
        return pa.table({"chunk": left.column("chunk"), "bucket": left.column("bucket"), "counts": pa.array(out, pa.binary())})

    asked = chunked.select("chunk", "rare").mapInArrow(ask, "bucket long, chunk long, asked binary")
    answers = asked.groupBy("bucket").cogroup(vocabulary.where("bucket >= 0").select("bucket", "words").groupBy("bucket")).applyInArrow(answer, "chunk long, bucket long, counts binary")
    base = float(np.log10(model.tokens + FLOOR * (model.distinct + 1)))
    n_train = model.tokens

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rare_n = left.column("rare_n").combine_chunks().flatten().to_numpy()
        h = np.frombuffer(left.column("rare")[0].as_py(), np.uint64)
        c = np.zeros(len(h), np.int64)
        if len(h):
            got = sorted(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist()))
            c[np.argsort(h, kind="stable")] = np.concatenate([_unpack(b, "i8")[0] for _, b in got])
        doc = np.repeat(np.arange(len(rare_n)), rare_n)
        column = lambda name: left.column(name).combine_chunks().flatten()
        tokens = column("n_tokens").to_numpy()
        logs = column("logs").to_numpy() + np.bincount(doc, np.log10(c + FLOOR), len(rare_n))
        known = column("known").to_numpy() + np.bincount(doc[c > 0], minlength=len(rare_n))
        train_ = column("train").to_numpy(zero_copy_only=False)
        return pa.table({
            "id": column("id"), "held_out": pa.array(~train_), "n_tokens": pa.array(tokens), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(tokens), n_train)),
            "base_score": pa.array(logs - tokens * base), "score": pa.array(logs + column("part").to_numpy()),
        })

    out = chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
