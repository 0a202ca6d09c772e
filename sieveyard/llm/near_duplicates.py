"""Near-duplicate documents by SetSketch registers.

A register is the least of the exponential variates that a set's elements draw for it, kept as its
logarithm to a small base and truncated to a fixed range.  Sketches of parts merge by taking the greater register.
Bands of three registers give buckets.  Pairs from buckets pass a joint likelihood over (greater, smaller,
equal) registers, then a check on the full sets.

No bucket is expanded into pairs.  The least document of a bucket is its hub; all that share a hub form a group, which
travels once, in tiles of bounded size, each with the hub.  A task compares a tile's documents and passes on a spanning
forest.  Only documents of a large group that their tile leaves outside the hub's component meet the other tiles.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sieveyard.llm.components import components, local_labels
from sieveyard.llm.hashing import U, Words, buffers, chunks, mix
from sieveyard.llm.staging import drop, stage
from sieveyard.llm.substring_duplicates import FLUSH, SEGMENT_BITS, CountMin, merged, repeated, sent

REGISTERS, ROWS = 72, 3
BASE, RATE, HIGHEST = 1.02, 20.0, 4000
_LOG = math.log(BASE)
#: Documents and shingles of a tile.
TILE_DOCS, TILE_SHINGLES = 512, 1_000_000


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and shingle hashes, distinct and sorted within each text.  Under ``k`` words: one shingle of all."""
    at, h = words.windows(k)
    doc = words.doc[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            whole[has] = whole[has] * U(0xD1342543DE82EF95) + words.hash[words.first[short[has]] + j]
        whole = mix(whole ^ (count[short].astype(np.uint64) << U(56)))
        order = np.argsort(np.concatenate([doc, short]), kind="stable")
        doc, h = np.concatenate([doc, short])[order], np.concatenate([h, whole])[order]
    bounds = np.searchsorted(doc, np.arange(words.n + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > 1:
            h[a:b].sort()
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
    return doc, h


def minima(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """For each text and register the least variate, ``inf`` where a text has no element.

    Each element runs through the points of a Poisson process of rate ``REGISTERS``, each point falling to a random
    register: a register's first point is exponential.  An element is done once it is beyond all its text's minima.
    """
    low = np.full((n, REGISTERS), np.inf)
    flat = low.reshape(-1)
    doc, state, time = doc.astype(np.int64), h.copy(), np.zeros(len(h))
    while len(doc):
        state += U(0x9E3779B97F4A7C15)
        draw = mix(state.copy())
        time = time - np.log(((draw >> U(12)).astype(np.float64) + 0.5) * 2.0**-52) / REGISTERS
        register = ((draw & U(0xFFF)) * U(REGISTERS)) >> U(12)
        np.minimum.at(flat, doc * REGISTERS + register.astype(np.int64), time)
        on = time <= low.max(axis=1)[doc]
        doc, state, time = doc[on], state[on], time[on]
    return low


def registers(low: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(low * (1 / RATE)) / _LOG), 0, HIGHEST).astype(np.int16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def log_likelihood(greater: np.ndarray, smaller: np.ndarray, n1: np.ndarray, n2: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of a Jaccard similarity, given the sizes and how many registers of the first are greater and smaller."""
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG
    up, down = np.maximum(p(u - v * similarity), 1e-9), np.maximum(p(v - u * similarity), 1e-9)
    return greater * np.log(up) + smaller * np.log(down) + (REGISTERS - greater - smaller) * np.log(np.maximum(1 - up - down, 1e-9))


def plausible(a: np.ndarray, b: np.ndarray, n1: np.ndarray, n2: np.ndarray, threshold: float, doubt: float = 20.0) -> np.ndarray:
    """Pairs whose most likely similarity reaches the threshold, or beats it by a likelihood ratio under e**``doubt``.

    At 20 a pair at the threshold is lost about once in 10**9.
    """
    greater, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    at = log_likelihood(greater, smaller, n1, n2, np.full(len(n1), threshold))
    best = np.full(len(n1), -np.inf)
    for j in np.linspace(0, threshold, 41):
        best = np.maximum(best, log_likelihood(greater, smaller, n1, n2, np.full(len(n1), j)))
    return best - at <= doubt


def digests(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    first, last = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(h):
        at = np.flatnonzero(np.diff(doc, prepend=-1))
        first[doc[at]] = np.add.reduceat(h, at)
        last[doc[at]] = np.bitwise_xor.reduceat(mix(h + U(1)), at)
    return first, last


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in chunks(offsets):
                doc, h = shingle_sets(Words(data, offsets[i : j + 1], lower=True), k)
                size = np.bincount(doc, minlength=j - i)
                regs = registers(minima(doc, h, j - i))
                first, last = digests(doc, h, j - i)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(first.view(np.int64)), pa.array(last.view(np.int64)), pa.array([r.tobytes() if n else None for r, n in zip(regs, size)], pa.binary())],
                    names=["id", "n", "h1", "h2", "regs"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, h1 long, h2 long, regs binary")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, wide: int = 24, step: int = 4096) -> np.ndarray:
    """How many elements each of the ``left`` sets shares with each of the ``right``, by their numbers.

    Elements in more than ``wide`` sets are counted by matrix products of ``step`` elements, the others by their pairs of sets.
    """
    used = np.union1d(left, right)
    place = np.full(len(sets), -1)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    h = np.concatenate([sets[i] for i in used])
    order = np.argsort(h, kind="stable")
    h, row = h[order], row[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(at, len(h)))
    n = len(used)
    shared = np.zeros((n, n), np.float32)
    few = np.repeat((size > 1) & (size <= wide), size)
    r, e = row[few], np.repeat(np.arange(len(at)), size)[few]
    for s in range(1, min(wide, int(size.max(initial=1)))):
        same = np.flatnonzero(e[:-s] == e[s:]) if len(e) > s else np.empty(0, np.int64)
        if not len(same):
            break
        shared += np.bincount(r[same] * n + r[same + s], minlength=n * n).reshape(n, n)
    shared += shared.T
    many = np.flatnonzero(size > wide)
    for k in range(0, len(many), step):
        part = many[k : k + step]
        has = np.zeros((n, len(part)), np.float32)
        has[row[np.concatenate([np.arange(at[i], at[i] + size[i]) for i in part])], np.repeat(np.arange(len(part)), size[part])] = 1
        shared += has @ has.T
    out = shared[np.ix_(place[left], place[right])].astype(np.int64)
    out[left[:, None] == right[None, :]] = 0
    return out


def similar(shared: np.ndarray, n1: np.ndarray, n2: np.ndarray, share: int) -> np.ndarray:
    return 100 * shared >= share * (n1 + n2 - shared)


class Group:
    """Documents of one tile as they arrive: node numbers stand for ids."""

    def __init__(self):
        self.ids: list = []
        self.sets: list[np.ndarray] = []
        self.regs: list[bytes] = []
        self.marks: list[bool] = []  # the hub, or those that are compared with the others
        self.parts: list = []  # the components they are in

    def add(self, node, h: np.ndarray, regs: bytes, mark: bool, part) -> None:
        if self.ids and self.ids[-1] == node and np.array_equal(self.sets[-1], h):
            self.marks[-1] |= mark  # a repeated row
            return
        for column, value in zip((self.ids, self.sets, self.regs, self.marks, self.parts), (node, h, regs, mark, part)):
            column.append(value)

    def links(self, share: int, star: bool) -> Iterator[tuple]:
        """Edges that join the components found in the tile.

        With ``star`` all are first compared with the marked one, the hub, and who is not linked with it with all others; without, the marked ones with all.
        Documents of one component are not compared.
        """
        n = len(self.ids)
        if n < 2 or not any(self.marks):
            return
        nodes, label = np.unique(np.array(self.parts), return_inverse=True)
        label = label.astype(np.int64)
        size = np.array([len(s) for s in self.sets])
        regs = np.frombuffer(b"".join(self.regs), np.int16).reshape(-1, REGISTERS)
        marks = np.flatnonzero(self.marks)

        def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = (np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * share) & (label[a] != label[b])
            at = np.flatnonzero(ok)
            for k in range(0, len(at), 65_536):
                part = at[k : k + 65_536]
                ok[part] = plausible(regs[a[part]], regs[b[part]], size[a[part]].astype(float), size[b[part]].astype(float), share / 100)
            return ok

        def join(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal label
            label = local_labels(len(nodes), label[a], label[b])[label]

        rest = marks
        if star:
            hub = marks[0]
            at = np.arange(n)
            at = at[likely(np.full(n, hub), at)]
            if len(at):
                shared = np.array([np.count_nonzero(found(self.sets[hub], self.sets[i])) for i in at])
                at = at[similar(shared, size[hub], size[at], share)]
                join(np.full(len(at), hub), at)
            rest = np.flatnonzero(label != label[hub])
        if len(rest):
            a, b = np.repeat(rest, n), np.tile(np.arange(n), len(rest))
            once = ~np.isin(b, rest) | (a < b)
            a, b = a[once], b[once]
            on = likely(a, b)
            a, b = a[on], b[on]
            if len(a) <= 4 * n:
                shared = np.array([np.count_nonzero(found(self.sets[i], self.sets[j])) for i, j in zip(a, b)], np.int64)
            else:
                left, right = np.unique(a), np.unique(b)
                shared = overlaps(self.sets, left, right)[np.searchsorted(left, a), np.searchsorted(right, b)]
            on = similar(shared, size[a], size[b], share)
            join(a[on], b[on])
        old, first = np.unique(np.array(self.parts), return_index=True)
        for k, i in enumerate(first):
            root = nodes[label[i]]
            if root != old[k]:
                yield old[k].item(), root.item()


def found(members: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of ``asked`` are among the sorted ``members``."""
    if not len(members):
        return np.zeros(len(asked), bool)
    return members[np.minimum(np.searchsorted(members, asked), len(members) - 1)] == asked


def _among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test that passes all of ``ids(rep)`` and few others, so that other texts need not be shuffled for a join that leaves them out.

    It is a count-min sketch to which every id is added twice, of 8 cells an id and at most 2**28 (96 MB); beyond, more others pass.
    """
    hashed = ids.select(F.xxhash64("rep").alias("h"))
    bits, rows = max(SEGMENT_BITS, min(28, (8 * max(1, ids.count())).bit_length())), 3

    def sketch(batches):
        own, held = CountMin(bits, rows), 0
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            own.add(h)
            own.add(h)
            held += 2 * len(h)
            if held > FLUSH:
                yield from sent(own)
                held = 0
        yield from sent(own)

    cells = hashed.mapInArrow(sketch, "segment long, once binary, more binary").groupBy("segment").applyInArrow(merged, "segment long, more binary").toArrow()
    shared = ids.sparkSession.sparkContext.broadcast((uuid.uuid4().int, bits, rows, list(zip(cells.column("segment").to_pylist(), cells.column("more").to_pylist()))))

    @F.pandas_udf("boolean")
    def among(h: pd.Series) -> pd.Series:
        return pd.Series(repeated(shared).test(h.to_numpy().view(np.uint64)))

    return lambda column: among(F.xxhash64(column))


def _linked(rows: DataFrame, keys: list[str], k: int, share: int, star: bool) -> DataFrame:
    """``a, b``: edges found within the groups of ``rows(*keys, rep, part, mark, h1, regs, text)``, one group after another."""

    def run(batches):
        group, key, out = Group(), None, ([], [])

        def end():
            for a, b in group.links(share, star):
                out[0].append(a)
                out[1].append(b)

        for batch in batches:
            if not batch.num_rows:
                continue
            names = {name: i for i, name in enumerate(batch.schema.names)}
            column = lambda name: batch.column(names[name])  # noqa: B023, E731
            data, offsets = buffers(column("text"))
            head = list(zip(*(column(name).to_pylist() for name in keys)))
            reps, parts, marks, h1, regs = (column(name).to_pylist() for name in ("rep", "part", "mark", "h1", "regs"))
            for i, j in chunks(offsets):
                doc, h = shingle_sets(Words(data, offsets[i : j + 1], lower=True), k)
                first = digests(doc, h, j - i)[0].view(np.int64)
                bounds = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(i, j):
                    if head[d] != key:
                        end()
                        group, key = Group(), head[d]
                    if first[d - i] == h1[d]:  # else another text of the same id
                        group.add(reps[d], h[bounds[d - i] : bounds[d - i + 1]].copy(), regs[d], marks[d], parts[d])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, arrow) for x in out], names=["a", "b"])
                out = ([], [])
        end()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, arrow) for x in out], names=["a", "b"])

    kind = rows.schema["rep"].dataType
    arrow = to_arrow_type(kind)
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "rep", "h1")
    return placed.select(*keys, "rep", "part", "mark", "h1", "regs", "text").mapInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}")


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile_docs: int = TILE_DOCS, tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """``id, n_shingles, component_id, kept``: one row for each document.

    Two documents are linked if their sets of ``k``-word shingles (A-Z lower-cased) have a Jaccard similarity of
    ``threshold`` (whole hundredths) or more.  ``component_id`` is the smallest id reachable; ``kept`` says it is the row's own.

    Null, empty and wordless texts have no shingle and are linked with nothing.  Under ``k`` words the whole sequence is the one
    shingle.  Repeated rows count as copies.  A null id is in no link and is kept.  Ids are integers or strings.  Other columns are ignored.

    Copies (equal sets) count once.  Documents that share a bucket meet in the group of the bucket's hub, cut into tiles of about
    ``tile_docs`` documents and ``tile_shingles`` shingles.  In a tile all are compared with the hub and whoever is not linked with
    it with all the others.  Of a group of several tiles, documents that are then not in the hub's component are dealt in blocks, and
    each block meets each tile.  So every pair of a bucket is compared or known to be in one component; no cap.
    """
    share = round(100 * threshold)
    found_ = stage(_sketches(docs, id_col, text_col, k), "sketches")
    filled = found_.where("n > 0 and id is not null")
    reps = stage(filled.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "reps")
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + i * width, width)) for i in range(REGISTERS // ROWS)])
    keyed = reps.select("rep", F.explode(keys).alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("met")).where("met > 1")
    of_rep = keyed.join(hubs, "key").groupBy("rep").agg(F.collect_set("hub").alias("hubs"))
    candidates = stage(reps.join(of_rep, "rep").select("rep", "h1", "n", "regs", "hubs"), "candidates")
    grouped = candidates.select("rep", "n", F.explode("hubs").alias("hub"))
    tiles = F.ceil(F.greatest(F.count("*") / tile_docs, F.sum("n") / tile_shingles)).cast("int")
    large = stage(grouped.groupBy("hub").agg(tiles.alias("tiles")).where("tiles > 1"), "large")
    texts = lambda ids: docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).where(F.col("rep").isNotNull() & _among(ids)(F.col("rep")))
    share_of = lambda of, name: F.pmod(F.xxhash64(F.lit(name), "rep"), of).cast("int")

    dealt = candidates.select("rep", "h1", "regs", F.explode("hubs").alias("hub")).join(large, "hub", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    everywhere = F.when(F.col("rep") == F.col("hub"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(share_of(F.col("tiles"), "tile")))
    placed = dealt.withColumn("tile", F.explode(everywhere)).select("rep", "h1", "regs", "hub", "tile")
    rows = placed.join(texts(candidates), "rep").withColumn("part", F.col("rep")).withColumn("mark", F.col("rep") == F.col("hub"))
    links = stage(_linked(rows, ["hub", "tile"], k, share, star=True), "links")
    joined = components(links)
    drop(links)
    if large.limit(1).count():
        # documents of large groups, with what their tile found; the hub's component is the group's main one
        named = joined.withColumnRenamed("component", "part")
        inside = grouped.join(large, "hub").join(named.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
        mains = large.join(named.select(F.col("node").alias("hub"), F.col("part").alias("main")), "hub", "left").select("hub", F.coalesce("main", "hub").alias("main"))
        inside = stage(inside.join(mains, "hub").select("hub", "rep", "part", "tiles", (F.col("part") != F.col("main")).alias("rest")), "inside")
        rest = inside.where("rest").groupBy("hub").agg(F.ceil(F.count("*") / tile_docs).cast("int").alias("blocks"))
        rest = stage(rest, "rest")
        if rest.limit(1).count():
            here = inside.join(rest, "hub")
            asking = here.where("rest").select("hub", "rep", "part", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), share_of(F.col("blocks"), "block").alias("block"), F.lit(True).alias("mark"))
            asked = here.select("hub", "rep", "part", share_of(F.col("tiles"), "tile").alias("tile"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("mark"))
            met = asking.unionByName(asked).groupBy("hub", "tile", "block", "rep", "part").agg(F.max("mark").alias("mark"))
            rows = met.join(candidates.select("rep", "h1", "regs"), "rep").join(texts(here), "rep")
            more = _linked(rows, ["hub", "tile", "block"], k, share, star=False)
            joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(stage(more, "links")))
    named = reps.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = found_.select("id", "n", "h1", "h2", (F.col("n") > 0).alias("has")).join(named.withColumn("has", F.lit(True)), ["h1", "h2", "has"], "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))
