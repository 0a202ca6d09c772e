"""Near-duplicate embeddings: spherical k-means cells, cosines within cells, a representative of each group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveyard.llm.components import components, local_labels
from sieveyard.llm.staging import stage
from sieveyard.llm.vectors import finite, matrix


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows to length 1, scaled first so that no square overflows or vanishes."""
    if not len(rows):
        return rows
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of unit rows; a cell that empties keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:cells]].copy()
    for _ in range(rounds):
        home = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        norm = np.sqrt((sums * sums).sum(axis=1))
        ok = norm > 1e-9
        moved = centres.copy()
        moved[ok] = sums[ok] / norm[ok, None]
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    return centres


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.9, probes: int = 4, per_cell: int = 2048, most_cells: int = 4096, sample: int = 16384, tile: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n_links, component_id, kept``: one row for each vector.

    Two vectors are linked if their cosine, in double precision, is ``threshold`` or more.  ``n_links`` counts the other
    rows linked directly, ``component_id`` is the smallest id reachable, ``kept`` says it is the row's own.  Null vectors, empty and zero ones
    and those with a null, NaN or infinite component are linked with nothing; so are rows with a null id.  Vectors are
    compared with those of their own length only.  Ids are integers.  Other columns are ignored.

    The centres come from at most about ``sample`` vectors; every vector then joins its ``probes`` nearest cells, and pairs
    that share a cell are compared.  Equal vectors count once, with their number.  A cell of any size is cut into
    tiles of about ``tile`` vectors and every pair of tiles is compared in a task of its own, which passes on counts and a
    spanning forest of its links, not the pairs.  A pair that shares several cells counts in the first.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    good = finite("v") & F.col("id").isNotNull() & F.exists("v", lambda x: x.cast("double") != 0)
    classes = stage(rows.where(good).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    size = classes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(1)).alias("width")).first()
    n, width = int(size["n"]), int(size["width"])
    cells = int(min(most_cells, max(1, n // per_cell)))
    drawn = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(n, 1))) + 1).select("v").toArrow()
    points = unit(matrix(drawn.column("v"), width)) if drawn.num_rows else np.zeros((1, width))
    centres = vectors.sparkSession.sparkContext.broadcast(spherical_kmeans(points, cells))
    tiles = F.lit(max(1, -(-n * probes // (cells * tile))))

    def assign(batches):
        c = centres.value
        p = min(probes, len(c))
        for batch in batches:
            if batch.num_rows:
                near = unit(matrix(batch.column(2), width)) @ c.T
                best = np.sort(np.argpartition(-near, p - 1, axis=1)[:, :p], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, p, dtype=np.int32)), pa.array(best.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["rep", "copies", "v", "cells"])

    kind = vectors.schema[id_col].dataType.simpleString()
    vkind = vectors.schema[vector_col].dataType.simpleString()
    assigned = stage(classes.select("rep", "copies", "v").mapInArrow(assign, f"rep {kind}, copies long, v {vkind}, cells array<int>"), "cells")
    # tiles of a cell: as many as its own size asks for
    counts = assigned.select(F.explode("cells").alias("cell"), F.size("v").alias("len")).groupBy("cell", "len").agg(F.count("*").alias("n"))
    cut = {(r["cell"], r["len"]): max(1, -(-r["n"] // tile)) for r in counts.where(F.col("n") > tile).collect()}  # at most cells x lengths
    spread = assigned.select("rep", "copies", "v", "cells", F.explode("cells").alias("cell"), F.size("v").alias("len"))
    cuts = F.lit(1)
    if cut:
        table = F.create_map(*[F.lit(x) for (c, w), m in cut.items() for x in (f"{c}/{w}", m)])
        cuts = F.coalesce(table[F.concat_ws("/", "cell", "len")], F.lit(1))
    spread = spread.withColumn("cuts", cuts).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    # tile t takes part in the pairs (i, t) and (t, j)
    partners = F.transform(F.sequence(F.lit(0), (F.col("cuts") - 1).cast("int")), lambda j: F.struct(F.least("tile", j).alias("i"), F.greatest("tile", j).alias("j")))
    dealt = spread.withColumn("pair", F.explode(partners)).select("cell", "len", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "tile", "rep", "copies", "v", "cells")

    def compare(t: pa.Table) -> pa.Table:
        first, second, cell = t.column("i")[0].as_py(), t.column("j")[0].as_py(), t.column("cell")[0].as_py()
        side, rep, copies = t.column("tile").to_numpy(), t.column("rep").to_numpy(), t.column("copies").to_numpy()
        v, own = unit(matrix(t.column("v"), width)), matrix(t.column("cells"), min(probes, len(centres.value)), np.int64)
        a, b = np.flatnonzero(side == first), np.flatnonzero(side == second)
        x, y = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(a), 512):
            r, c = np.nonzero(v[a[at : at + 512]] @ v[b].T >= threshold)
            r, c = a[at + r], b[c]
            once = r < c if first == second else np.ones(len(r), dtype=bool)
            x.append(r[once])
            y.append(c[once])
        r, c = np.concatenate(x), np.concatenate(y)
        counted = np.ones(len(r), dtype=bool)
        for k in range(own.shape[1]):
            earlier = own[r, k] < cell
            counted &= ~(earlier & (own[c] == own[r, k][:, None]).any(axis=1))
        links = np.bincount(r[counted], copies[c[counted]], len(rep)) + np.bincount(c[counted], copies[r[counted]], len(rep))
        label = local_labels(len(rep), r, c)
        on = np.flatnonzero((links > 0) | (label != np.arange(len(rep))))
        return pa.table({"rep": pa.array(rep[on], pa.int64()), "links": pa.array(links[on].astype(np.int64)), "to": pa.array(rep[label[on]], pa.int64())})

    found = stage(dealt.groupBy("cell", "len", "i", "j").applyInArrow(compare, "rep long, links long, to long"), "links")
    joined = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(joined.withColumnRenamed("node", "rep"), "rep", "full_outer")
    named = classes.join(linked, "rep", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.withColumn("good", good).join(named.withColumn("good", F.lit(True)), ["v", "good"], "left")
    component = F.when(F.col("id").isNull(), F.col("id")).otherwise(F.coalesce(F.col("component").cast(kind), F.col("id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))
