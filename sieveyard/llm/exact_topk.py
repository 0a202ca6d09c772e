"""Exact top-k inner products by the threshold algorithm.

Within a block of candidates each dimension has its list of rows sorted by value.  A query reads the lists from the end that
its component's sign favours, to growing depths, scores each new row at once, and stops when the sum of
its components times the values at that depth, which no unread row can beat, is under its kth score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveyard.llm.vectors import finite, matrix


class SortedLists:
    """A block of integer vectors with its per-dimension lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.rows, self.order, axis=0)

    def top(self, query: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows other than ``own``, by score, ties to the smaller id.

        It stops only when the bound is strictly under the kth score: an unread row could tie with a smaller id.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        score = np.zeros(n, dtype=self.rows.dtype)
        read = np.zeros(n, dtype=bool)
        other = self.ids != own if own is not None else np.ones(n, dtype=bool)
        last, depth = 0, max(k, n // 128, 8)
        while True:
            if depth >= n or not len(up) + len(down):
                new = np.flatnonzero(~read)
            else:
                seen = np.zeros(n, dtype=bool)
                seen[self.order[n - depth : n - last, up].ravel()] = True
                seen[self.order[last:depth, down].ravel()] = True
                new = np.flatnonzero(seen & ~read)
            score[new] = self.rows[new] @ query
            read[new] = True
            at = np.flatnonzero(read & other)
            if len(at) > k:
                kth = np.partition(score[at], len(at) - k)[len(at) - k]
                at = at[score[at] >= kth]
            if read.all():
                break
            if len(at) >= k:
                bound = self.sorted[n - depth, up] @ query[up] + self.sorted[depth - 1, down] @ query[down]
                if kth > bound:
                    break
            last, depth = depth, 2 * depth
        best = at[np.lexsort((self.ids[at], -score[at]))][:k]
        return self.ids[best], score[best]


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 16384, query_block: int = 2048) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its ``k`` best other rows of ``vectors``.

    A component x counts as floor(scale * x), the score is the integer inner product, equal scores go by the smaller id, and
    a query with fewer than ``k`` candidates returns them all.  Vectors that are null or hold null, NaN or infinite
    components take no part; neither do null ids.  Shorter vectors count as filled up with zeros; an empty one scores 0.
    A scaled component or a score beyond 64 bits raises an error.
    A query leaves out every row with its own id.  Repeated rows are rows of their own.  Other columns are ignored.

    Blocks of queries meet blocks of candidates, one task each, and pass on ``k`` rows a query.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def scaled(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0**63, F.floor(y)).otherwise(F.raise_error(F.lit("a scaled component is beyond 64 bits")).cast("long"))

    def whole(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(finite("v") & F.col("id").isNotNull())
        return rows.select("id", F.transform("v", scaled).alias("v"))

    rows, asked = whole(vectors), whole(queries)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0)).alias("most")).first()
    width = int(max(size["width"], 1))
    blocks, query_blocks = max(1, -(-size["n"] // block)), max(1, -(-asked.count() // query_block))
    #: Float sums of integers are exact under 2**53; beyond that Python's own integers are used.
    exact = float(size["most"]) ** 2 * width < 2**52
    deal = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = rows.select("id", "v", deal("id", blocks).alias("b"), every(query_blocks).alias("q"), F.lit(False).alias("asks")).unionByName(
        asked.select("id", "v", deal("id", query_blocks).alias("q"), every(blocks).alias("b"), F.lit(True).alias("asks"))
    )

    def run(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        ids = t.column("id").to_numpy()
        data = matrix(t.column("v"), width, np.float64 if exact else object)
        if not exact:
            data = data.astype(object)
        out: list[list] = [[], [], []]
        if (~asks).any():
            lists = SortedLists(ids[~asks], data[~asks])
            for own, query in zip(ids[asks], data[asks]):
                best, score = lists.top(query, k, own)
                out[0].append(np.full(len(best), own))
                out[1].append(best)
                out[2].append(score.astype(np.int64))
        return pa.table({n: pa.array(np.concatenate(c) if c else np.empty(0), pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    near = sides.groupBy("q", "b").applyInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("query_id").cast(kind).alias("query_id"), "rank", F.col("vec_id").cast(kind).alias("vec_id"), "score")
