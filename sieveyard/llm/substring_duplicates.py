"""Repeated passages: windows of words that also start earlier.

First pass: each partition sketches its windows' hashes by count-min, as counts of none, one and more, over as many
cells as the number of windows asks for.  Sketches are sparse, cut into segments, and merge by segment.  Counts
are never under the truth, so a window that occurs twice stands in cells that say "more" in every row.
Second pass: only windows so estimated are grouped exactly, by 96 bits of two hashes, for the first place they start at; each
partition passes on a window once.  Each document then learns which of its windows are first, and loses the words
of the others.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sieveyard.llm.hashing import U, Words, buffers, chunks, mix
from sieveyard.llm.worker_cache import held

SEGMENT_BITS = 18
FLUSH = 3_000_000


def cells_of(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """A window's cell in one row of the sketch."""
    return (mix(h + U((row + 1) * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF)) >> U(64 - bits)).astype(np.int64)


class CountMin:
    """Counts saturating at two: ``once`` and ``more`` are bit maps of each row's cells."""

    def __init__(self, bits: int, rows: int):
        self.bits, self.rows = bits, rows
        self.cells: list[list[np.ndarray]] = [[] for _ in range(rows)]

    def add(self, h: np.ndarray) -> None:
        for row in range(self.rows):
            self.cells[row].append(cells_of(h, row, self.bits).astype(np.uint32))

    def segments(self):
        """``segment, sorted positions of cells seen once, of cells seen more``, empty ones left out."""
        span = 1 << min(SEGMENT_BITS, self.bits)
        for row in range(self.rows):
            all_cells = np.sort(np.concatenate(self.cells[row])) if self.cells[row] else np.empty(0, np.uint32)
            self.cells[row] = []
            if not len(all_cells):
                continue
            first = np.ones(len(all_cells), dtype=bool)
            first[1:] = all_cells[1:] != all_cells[:-1]
            again = np.zeros(len(all_cells), dtype=bool)
            at = np.flatnonzero(first)
            again[at] = np.diff(np.append(at, len(all_cells))) > 1
            cell, more = all_cells[first].astype(np.int64), again[first]
            segment = cell // span
            bounds = np.flatnonzero(np.diff(segment, prepend=-1))
            for a, b in zip(bounds, np.append(bounds[1:], len(cell))):
                inside = cell[a:b] - segment[a] * span
                m = more[a:b]
                yield row << 32 | int(segment[a]), pack(inside[~m]), pack(inside[m])


def pack(positions: np.ndarray) -> bytes:
    """Sorted distinct positions as gaps, a byte each where gaps allow."""
    gaps = np.diff(positions, prepend=-1) - 1
    for code, kind in enumerate(("u1", "<u2", "<u4")):
        if not len(gaps) or gaps.max() <= np.iinfo(kind).max:
            return bytes([code]) + gaps.astype(kind).tobytes()
    raise ValueError("position out of range")


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, ("u1", "<u2", "<u4")[data[0]], offset=1).astype(np.int64) + 1) - 1


class Repeated:
    """The merged sketch's "more" bits."""

    def __init__(self, bits: int, rows: int, segments: list[tuple[int, bytes]]):
        self.bits, self.rows = bits, rows
        self.maps = np.zeros((rows, max(1, (1 << bits) // 8)), np.uint8)
        span = (1 << min(SEGMENT_BITS, bits)) // 8 or 1
        for key, data in segments:
            at = (key & 0xFFFFFFFF) * span
            self.maps[key >> 32, at : at + span] = np.frombuffer(zlib.decompress(data), np.uint8)

    def test(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for row in range(self.rows):
            c = cells_of(h, row, self.bits)
            out &= (self.maps[row, c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
        return out


def repeated(shared) -> Repeated:
    """One copy of the merged sketch in each Python worker."""
    return held(shared.value[0], lambda: Repeated(*shared.value[1:]))


class Places:
    """Candidate windows with the first place of each: two hashes, id, word number."""

    KINDS = ("u8", "u4", "i8", "i4")

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, h: np.ndarray, again: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        self.parts.append((h, again, ids, at))
        self.size += len(h)

    def firsts(self) -> tuple[np.ndarray, ...]:
        """Sorted by hash."""
        if not self.parts:
            return tuple(np.empty(0, k) for k in self.KINDS)
        h, again, ids, at = (np.concatenate(x) for x in zip(*self.parts))
        self.__init__()
        order = np.lexsort((at, ids, again, h))
        h, again, ids, at = h[order], again[order], ids[order], at[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (again[1:] != again[:-1])
        return h[first], again[first], ids[first], at[first]


def sent(own: CountMin):
    out: list[list] = [[], [], []]
    for found in own.segments():
        for c, v in zip(out, found, strict=True):
            c.append(v)
        if len(out[0]) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["segment", "once", "more"])
            out = [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["segment", "once", "more"])


def merged(t: pa.Table) -> pa.Table:
    seen = np.zeros(1 << SEGMENT_BITS, np.uint8)
    for a, b in zip(t.column("once"), t.column("more")):
        at = unpack(a.as_py())
        seen[at] = np.minimum(seen[at] + 1, 2)
        seen[unpack(b.as_py())] = 2
    bitmap = zlib.compress(np.packbits(seen == 2, bitorder="little").tobytes(), 1)
    return pa.table({"segment": t.column("segment")[:1], "more": pa.array([bitmap], pa.binary())})


def to_blob(*columns: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), 1)


def from_blob(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zlib.decompress(blob)
    n, out, at = len(data) // sum(np.dtype(k).itemsize for k in kinds), [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def kept_words(data: bytes, removed: np.ndarray) -> bytes:
    words = data.split()
    if removed.any():
        edges = np.flatnonzero(np.diff(np.concatenate([[True], removed, [True]]).astype(np.int8)))
        words = [w for a, b in edges.reshape(-1, 2) for w in words[a:b]]
    return b" ".join(words)


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", rows: int = 2, most_bits: int = 29, words_as: str = "n_words", removed_as: str = "n_removed", leave_untouched: bool = False) -> DataFrame:
    """``docs`` with each text less its repeated words, joined by single spaces, and the numbers of words and of removed words.

    A word goes if a window of ``window`` consecutive words covers it whose word sequence also starts earlier: in a document
    of a smaller id, or in the same one further left.  Windows are judged on the input.  Null and empty texts have no words
    and give an empty text, as do texts removed whole; none is dropped.  Shorter texts than a window stay.  Rows of the same id
    count as the same document: a window's first place is shared by all of them.  A null id comes after all others.  Ids are
    integers.  With ``leave_untouched`` a text that loses no word keeps its white space, and a null its null.  Other columns pass through; columns named as the new ones are replaced.

    The sketch has up to ``rows * 2**most_bits`` bits (128 MB), the bound of what is broadcast.  Beyond some 10**9 windows it lets ever more
    windows pass to the exact grouping, which needs no sketch to be right.
    """
    spark = docs.sparkSession
    base = docs.drop(words_as, removed_as).withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)))
    texts = base.select(F.col("__id").alias("id"), F.col(text_col).alias("text"))
    size = int(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"])
    bits = max(SEGMENT_BITS, min(most_bits, int(size // 6 * 4).bit_length()))
    buckets, groups = max(256, size >> 24), max(256, size >> 24)

    def windows(batch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Words]]:
        data, offsets = buffers(batch.column(1))
        for i, j in chunks(offsets):
            words = Words(data, offsets[i : j + 1], lower=False)
            yield (*words.windows(window), np.arange(i, j), words)

    def sketch(batches):
        own, held = CountMin(bits, rows), 0
        for batch in batches:
            for at, h, _, _ in windows(batch):
                own.add(h)
                held += len(h)
                if held > FLUSH:
                    yield from sent(own)
                    held = 0
        yield from sent(own)

    found = texts.mapInArrow(sketch, "segment long, once binary, more binary").groupBy("segment").applyInArrow(merged, "segment long, more binary").toArrow()
    shared = spark.sparkContext.broadcast((uuid.uuid4().int, bits, rows, list(zip(found.column("segment").to_pylist(), found.column("more").to_pylist()))))

    def candidates(batches):
        again, own = repeated(shared), Places()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, h, texts_at, words in windows(batch):
                on = again.test(h)
                at, h = at[on], h[on]
                doc = words.doc[at]
                own.add(h, words.second(at, window).astype(np.uint32), ids[texts_at][doc], (at - words.first[doc]).astype(np.int32))
            if own.size > FLUSH // 2:
                yield from dealt(own)
        yield from dealt(own)

    def dealt(own: Places):
        h, again, ids, at = own.firsts()
        bucket = (h >> U(32)) * U(buckets) >> U(32)
        edges = np.append(np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1)), len(h))
        blobs = [to_blob(h[a:b], again[a:b], ids[a:b], at[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "places"])

    def owners(t: pa.Table) -> pa.Table:
        """Each window's first place, for the group of its document."""
        own = Places()
        for blob in t.column("places"):
            own.add(*from_blob(blob.as_py(), *Places.KINDS))
        _, _, ids, at = own.firsts()
        group = np.mod(ids ^ (ids >> 13), groups)
        order = np.lexsort((at, ids, group))
        group, ids, at = group[order], ids[order], at[order]
        edges = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        blobs = [to_blob(ids[a:b], at[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        return pa.table({"__group": pa.array(group[edges[:-1]]), "owned": pa.array(blobs, pa.binary())})

    firsts = texts.mapInArrow(candidates, "bucket long, places binary").groupBy("bucket").applyInArrow(owners, "__group long, owned binary")
    schema = StructType([*[StructField(f.name, f.dataType, True) for f in docs.drop(words_as, removed_as).schema], StructField(words_as, LongType()), StructField(removed_as, LongType())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        again = repeated(shared)
        parts = [from_blob(b.as_py(), "i8", "i4") for b in right.column("owned")]
        owned = np.concatenate([x for x, _ in parts]) if parts else np.empty(0, np.int64)
        where = np.concatenate([x for _, x in parts]) if parts else np.empty(0, np.int32)
        order = np.lexsort((where, owned))
        owned, where = owned[order], where[order].astype(np.int64)
        column = left.column(text_col).combine_chunks()
        texts_, total, gone = [], [], []
        for i, j in chunks(buffers(column)[1]):
            data, offsets = buffers(column.slice(i, j - i))
            words = Words(data, offsets, lower=False)
            at, h = words.windows(window)
            on = again.test(h)
            at = at[on]
            doc = words.doc[at]
            ids = left.column("__id").to_numpy()[i:j]
            start = at - words.first[doc]
            lo, hi = np.searchsorted(owned, ids[doc], "left"), np.searchsorted(owned, ids[doc], "right")
            later = np.ones(len(at), dtype=bool)
            for k in np.flatnonzero(np.diff(doc, prepend=-1)):  # one text's candidates at a time
                e = k + np.searchsorted(doc[k:], doc[k], "right")
                later[k:e] = ~np.isin(start[k:e], where[lo[k] : hi[k]], assume_unique=False)
            change = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(change, at[later], 1)
            np.add.at(change, at[later] + window, -1)
            removed = np.cumsum(change[:-1]) > 0
            for d in range(words.n):
                a, b = words.first[d], words.first[d + 1]
                if leave_untouched and not removed[a:b].any():
                    texts_.append(column[i + d].as_py())
                else:
                    texts_.append(kept_words(data[offsets[d] : offsets[d + 1]].tobytes(), removed[a:b]).decode())
                total.append(b - a)
                gone.append(int(removed[a:b].sum()))
        out = left.drop_columns(["__group", "__id"])
        out = out.set_column(out.schema.get_field_index(text_col), text_col, pa.array(texts_, pa.string()))
        return out.append_column(words_as, pa.array(total, pa.int64())).append_column(removed_as, pa.array(gone, pa.int64()))

    grouped = base.withColumn("__group", F.pmod(F.col("__id").bitwiseXOR(F.shiftright("__id", 13)), F.lit(groups)))
    return grouped.groupBy("__group").cogroup(firsts.groupBy("__group")).applyInArrow(finish, schema)
