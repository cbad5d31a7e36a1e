"""Exact top-k search by Fagin's threshold algorithm.

Vectors become integers and are dealt by a hash into blocks; a block keeps, for each dimension, its vectors in ascending order of that component. For a
query the lists are read in step, from the end where the query's sign makes the product largest; each vector met is scored in full. The sum of the
products at the places reached bounds every vector not met, so a query stops in a block once its kth score is above that bound (equal scores go by
id, so it reads on while the bound equals the kth). Queries come in blocks too; the best of all blocks are ranked together.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import ship_package
from pagewright.session import stored

K = 5
SCALE = 256
#: Vectors of a block that is searched, and queries that search it together.
BLOCK_ROWS, QUERY_ROWS = 8192, 512
#: Places of each list that are read before the bound is first looked at; the next stretch is twice as long, and so on.
FIRST_STEP = 16


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)``: components floored to integers. Vectors that are null, empty or hold a null or non-finite component, or without an id, are left out.

    A vector with a component so large that an inner product could pass 64 bits is refused with an error: no score is ever wrong.
    """
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = F.sqrt(F.lit(float(1 << 62)) / F.size("embedding"))
    small = F.forall("embedding", lambda c: F.abs(c.cast("double") * scale) <= most)
    floored = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    refused = F.raise_error(F.concat(F.lit("products of this vector's components could pass 64 bits: "), F.col("vec_id").cast("string"))).cast("array<bigint>")
    return vectors.filter("vec_id is not null").filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.when(small, floored).otherwise(refused).alias("x"))


class Lists:
    """A block's vectors and, for each dimension, its rows in ascending order of the component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.lists = np.ascontiguousarray(np.argsort(self.x, axis=0, kind="stable").T.astype(np.int32))

    def top(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best ``k``, the best first, and the depth that was read."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, FIRST_STEP
        while depth < n:
            reach = min(n, depth + step) if len(up) or len(down) else n
            met = np.zeros(n, bool)
            met[self.lists[up, n - reach:n - depth].ravel()] = True
            met[self.lists[down, depth:reach].ravel()] = True
            if not len(up) and not len(down):
                met[:] = True
            bound = int(self.x[self.lists[up, n - reach], up] @ q[up] + self.x[self.lists[down, reach - 1], down] @ q[down])
            rows = np.flatnonzero(met & ~seen)
            seen |= met
            rows = rows[self.ids[rows] != query_id]
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self.x[rows] @ q])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            depth, step = reach, step * 2
            if len(scores) == k and scores[-1] > bound:
                break
        return ids, scores, depth


def _search(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            width = {len(v) for v in right.column("x").to_pylist()}
            blocks = {}
            for w in width:  # vectors of another length have no product
                rows = [(i, v) for i, v in zip(right.column("vec_id").to_pylist(), right.column("x").to_pylist(), strict=True) if len(v) == w]
                blocks[w] = Lists(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64))
            for place, query, v in zip(left.column("place").to_pylist(), left.column("query_id").to_pylist(), left.column("q").to_pylist(), strict=True):
                if len(v) in blocks:
                    ids, scores, _ = blocks[len(v)].top(query, np.array(v, np.int64), k)
                    out.extend((place, query, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("place", "query_id", "vec_id", "score"), columns, strict=True)})
    return search


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row ``(query_id, q)`` the ``k`` rows ``(vec_id, x)`` of other ids with the largest inner product.

    Ties go to the smaller id. Rows repeated are candidates like others; a query repeated is answered once for each row, under its id, in
    the same ranks. Fewer candidates give fewer rows. Every block of queries meets every block of vectors: the work is theirs, the
    rows that meet in a task are at most a block of either.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    blocks, query_blocks = (max(1, -(-n // rows)) for n, rows in ((vectors.count(), BLOCK_ROWS), (queries.count(), QUERY_ROWS)))
    dealt = lambda df, n, *by: F.pmod(F.xxhash64(*by, F.monotonically_increasing_id()), F.lit(n)).cast("long")
    asked = stored(queries.select(F.monotonically_increasing_id().alias("place"), "query_id", "q").withColumn("qb", dealt(queries, query_blocks, "query_id")), "asked")
    held = stored(vectors.select("vec_id", "x").withColumn("vb", dealt(vectors, blocks, "vec_id")), "held")
    left = asked.withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = held.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    met = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(_search(k), "place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("place", "query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """The search whose queries are the rows with an id divisible by ``every``. Vectors that are null or hold a component that is null or not finite take no part, nor do
    rows without an id; ties go to the smaller id; an empty table finds nothing; other columns are not looked at."""
    x = integers(vectors)
    return search(x.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q")), x, k)
