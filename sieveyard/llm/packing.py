"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence.  The program asks for the fewest
configurations that cover the histogram.  Multiplicative weights solve it: each round prices the
lengths (dear where coverage lags), a knapsack dynamic program finds the dearest configuration, and
coverage grows.  The result is rounded down to whole uses, and best fit places what is left.  All this works
on at most ``capacity`` lengths, however many documents there are; the documents then look up their places.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from dataclasses import dataclass
from unicodedata import category, is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveyard.llm.staging import stage
from sieveyard.llm.token_counts import byte_letters
from sieveyard.llm.worker_cache import release

#: Fixed value: the word pattern of the vocabulary with word ends.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: The same for characters of which Python's own classes and lower-casing say what the vocabulary's do.
QUICK = r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+"
OUTSIDE = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ňŊ-ɏ‐-‧‰-⁞€]"


def unassigned(text: str) -> bool:
    """Whether a character is newer than Python's tables, on which the pattern's library and the vocabulary's may disagree."""
    return any(category(c) == "Cn" for c in set(text))


#: Marks that are a word of their own at the end of a stretch of letters.
MARKS = frozenset(".,;:!?")


class WordIds(dict):
    """A bounded cache: a stretch without white space -> its ids as little-endian unsigned 32-bit integers.

    No word of the pattern holds white space, so stretches are encoded one by one.  A word is a stretch too, with itself as its only word,
    so that words are kept beside the stretches.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick, self.words, self.outside = re.compile(QUICK), regex.compile(WORDS), re.compile(OUTSIDE)
        self.control = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the pattern
        self.merge = self.tokenizer.model.tokenize  # words come lower-cased and cut, so they go to the merges at once
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
        self.packed = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, stretch: str) -> bytes:
        if self.outside.search(stretch):
            found = self.words.findall(stretch)
        elif stretch.isalpha():
            return self.learn(stretch)
        elif stretch[-1] in MARKS and stretch[:-1].isalpha():
            found = stretch[:-1], stretch[-1]
        else:
            found = self.quick.findall(stretch)
        out = b"".join([self.get(w) or self.learn(w) for w in found])
        return self.keep(stretch, out)

    def learn(self, word: str) -> bytes:
        plain = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return self.keep(word, b"".join([packed[t.id] for t in self.merge(plain)]))

    def keep(self, stretch: str, ids: bytes) -> bytes:
        if len(self) > self.most:
            self.clear()
        self[stretch] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """As the library gives them; texts with special strings or unusual characters go to it whole."""
        if "<|" in text and any(s in text for s in self.special):
            return self.encode(text)
        if self.outside.search(text) and (not is_normalized("NFC", text) or "Σ" in text or "İ" in text or self.control.search(text) or unassigned(text)):
            return self.encode(text)
        return b"".join(map(self.__getitem__, text.lower().split()))


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``id, piece, start, length, ids_crc32``: each document's ids and ``end_id``, cut only beyond ``capacity``."""

    def run(batches):
        release()
        words, end = WordIds(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.ids(text.as_py() or "") + end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    for col, v in zip(out, (doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def best_configuration(value: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Bounded knapsack: how often to take each length so that the value is greatest within ``capacity``."""
    items = []  # each length in lots of 1, 2, 4, ... up to its bound
    for i, (size, u) in enumerate(zip(lengths.tolist(), most.tolist())):
        lot = 1
        while u > 0:
            take = min(lot, u)
            items.append((i, take, size * take))
            u -= take
            lot *= 2
    best = np.zeros(capacity + 1)
    taken = np.zeros((len(items), capacity + 1), dtype=bool)
    for k, (i, take, size) in enumerate(items):
        with_it = best[: capacity + 1 - size] + value[i] * take
        better = with_it > best[size:]
        taken[k, size:] = better
        np.copyto(best[size:], with_it, where=better)
    counts, room = np.zeros(len(lengths), dtype=np.int64), int(np.argmax(best))
    for k in range(len(items) - 1, -1, -1):
        if taken[k, room]:
            counts[items[k][0]] += items[k][1]
            room -= items[k][2]
    return counts


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, eta: float = 4.0) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, by multiplicative weights on coverage."""
    covered = np.zeros(len(lengths))
    used: dict[bytes, list] = {}
    for _ in range(rounds):
        value = lengths * np.exp(-eta * (covered - covered.min()))
        c = best_configuration(value, lengths, np.minimum(counts, capacity // lengths), capacity)
        has = c > 0
        step = max(1.0, float((counts[has] / c[has]).min()) / 4)
        covered[has] += c[has] * step / counts[has]
        used.setdefault(c.tobytes(), [c, 0.0])[1] += step
        if covered.min() >= 1:
            break
    shrink = max(1.0, float(np.average(covered, weights=lengths * counts)))
    return [(c, x / shrink) for c, x in used.values()]


@dataclass(frozen=True)
class Place:
    """Items ``rank .. rank+count-1`` of ``length``: ``per`` of them in each sequence from ``sequence`` on, from ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    per: int
    offset: int


def plan(histogram: dict[int, int], capacity: int, rounds: int = 160, rounding: float = 0.5) -> tuple[list[Place], int]:
    """Places for every item of the histogram, and the number of sequences.  No item exceeds ``capacity``.

    Only configurations without a gap are used, ``rounding`` of the program's share of each: what is left then has
    short items enough to close the other sequences.
    """
    lengths = np.array(sorted(n for n in histogram if n < capacity), dtype=np.int64)
    left = {int(n): int(histogram[n]) for n in histogram}
    rank = dict.fromkeys(left, 0)
    places: list[Place] = []
    sequences = 0
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequences that have as many
    free: list[int] = []

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        places.append(Place(length, rank[length], n, first, per, offset))
        rank[length] += n
        left[length] -= n

    def open_room(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in room:
                bisect.insort(free, space)
            room.setdefault(space, []).append((first, n))

    if full := left.get(capacity, 0):
        put(capacity, full, 0, 1, 0)
        sequences = full
    if len(lengths):
        counts = np.array([left[int(n)] for n in lengths])
        solved = solve(lengths, counts, capacity, rounds)
        for c, x in sorted(solved, key=lambda s: -float((s[0] * lengths).sum()) * s[1]):
            at = np.flatnonzero(c)
            if int((c * lengths).sum()) < capacity:
                continue
            n = min(int(x * rounding), *(left[int(lengths[i])] // int(c[i]) for i in at))
            if n < 1:
                continue
            offset = 0
            for i in at[::-1]:
                size, per = int(lengths[i]), int(c[i])
                put(size, n * per, sequences, per, offset)
                offset += size * per
            open_room(capacity - offset, sequences, n)
            sequences += n
    for length in sorted((n for n in left if left[n]), reverse=True):
        while left[length]:
            k = bisect.bisect_left(free, length)
            if k == len(free):
                per = capacity // length
                n = -(-left[length] // per)
                first, space = sequences, capacity
                sequences += n
            else:
                space = free[k]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space]
                    free.pop(k)
                per = space // length
            whole = min(n, left[length] // per)
            if whole:
                put(length, whole * per, first, per, capacity - space)
                open_room(space - per * length, first, whole)
            if whole < n and left[length]:
                some = left[length]
                put(length, some, first + whole, some, capacity - space)
                open_room(space - some * length, first + whole, 1)
                whole += 1
            open_room(space, first + whole, n - whole)
    return places, sequences


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset``: every piece of every document, placed.

    Null and empty text: one piece that holds ``end_id`` alone.  A longer document than ``capacity`` is cut into
    pieces of ``capacity`` and a last one.  Repeated rows and null ids are documents like others; other columns
    are left out.  An empty table gives an empty result.

    Shuffles: the numbers of equal lengths only, a few bytes a piece.  Ranks within a length are dealt over
    buckets of it, so that a length that a third of all rows has is no single task.
    """
    spark = docs.sparkSession
    rows = stage(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places, _ = plan(histogram, capacity)
    places.sort(key=lambda p: (p.length, p.rank))
    table = spark.sparkContext.broadcast(np.array([[p.length << 44 | p.rank, p.rank, p.sequence, p.per, p.offset] for p in places], dtype=np.int64).reshape(-1, 5))

    buckets = max(32, sum(histogram.values()) // 100_000)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = (
        rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    )
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("within", within).join(before, ["length", "bucket"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("within") + F.col("before")).alias("rank"))

    def run(batches):
        t = table.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            p = t[np.searchsorted(t[:, 0], (length << 44) | rank, "right") - 1]
            k = rank - p[:, 1]
            sequence, offset = p[:, 2] + k // p[:, 3], p[:, 4] + k % p[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("id", id_col)
