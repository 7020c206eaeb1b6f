"""Approximate nearest neighbours by inner product: collision counting over query-centred windows.

Inner products become distances: a vector gets one more component that lifts it to the length of its block's longest, and a query,
scaled to that length, a zero; then a larger inner product is a smaller distance. A block keeps `projections` sorted arrays,
one for each random direction, each cut into 255 cells of equally many rows. A query puts a window around its own projection in every array; vectors inside
collide once for each: a window holds the cells whose middle row lies in it, a row's cell is a byte, and bytes are compared for all arrays at once (up to 255 rows, every row is its own cell). Virtual rehashing widens all windows by one factor after
another, from a width just below what the block's query before needed; a width that falls well short among an eighth of the block's rows, which lie in an order of hashes, isn't tried on the rest.
Vectors whose collisions reach `share` of the arrays are verified by their inner product in double precision. A block is done when `verified` of its rows, and `least` rows
for each neighbour asked for at least, have been verified. That target is a share, never a cap: vectors that reach the threshold in the same step are all verified.

Rows are dealt to blocks by a hash of their id, queries to blocks of their own; each pair of blocks is one task's work, and keeps the k best of each query.
The method counts every row for every query, so its work is queries times rows; a task's memory is two blocks. Recall on the test tables is in the README.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, and rows with a null id take no part. A query is compared with rows
of its own vector length. Repeated rows of one id count once (the smallest vector, if they differ). Equal products: the smaller id first. Fewer than k other rows: all of
them. Columns other than those named are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .neardup_vectors import matrix, valid


#: Cells of a sorted array at most: a cell's number, and a count of cells, are a byte.
CELLS = 255


class Block:
    """Sorted projections of some vectors, which lie in no particular order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projections: int, seed: int):
        self.ids, self.x = ids, x
        length = np.sqrt((x * x).sum(1))
        self.longest = length.max()
        lifted = np.concatenate([x, np.sqrt(np.maximum(0, self.longest**2 - length**2))[:, None]], 1) / self.longest
        self.directions = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1] + 1, projections))
        p = np.ascontiguousarray((lifted @ self.directions).T)
        n = len(x)
        cells = min(n, CELLS)
        ordered = np.sort(p, axis=1)
        self.middle = np.ascontiguousarray(ordered[:, (2 * np.arange(cells) + 1) * n // (2 * cells)].T)
        starts = ordered[:, np.arange(1, cells) * n // cells]
        self.cell = np.array([s.searchsorted(v, "right") for s, v in zip(starts, p, strict=True)], np.uint8)
        self.width = 0.5

    def collisions(self, low: np.ndarray, span: np.ndarray, rows: int) -> np.ndarray:
        """How many arrays have each of the first rows in one of the span cells from low on."""
        inside = self.cell[:, :rows] - low < span  # one comparison of unsigned differences
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8 if len(low) < 256 else np.uint32)

    def candidates(self, q: np.ndarray, share: float, verified: int, factor: float = 1.02) -> np.ndarray:
        """Rows whose collisions reach the threshold at the first width at which `verified` rows do."""
        m, n = self.cell.shape
        if n <= verified:
            return np.arange(n)
        centre = (np.append(q, 0.0) / np.sqrt(q @ q)) @ self.directions
        need = int(np.ceil(share * m))
        some = n // 8
        width = self.width * 0.97
        while True:
            low = np.add.reduce((self.middle < centre - width).view(np.uint8), axis=0, dtype=np.uint8)[:, None]
            span = np.add.reduce((self.middle <= centre + width).view(np.uint8), axis=0, dtype=np.uint8)[:, None] - low
            whole = span.min() == len(self.middle)
            if whole or some < 512 or np.count_nonzero(self.collisions(low, span, some) >= need) >= 0.8 * verified * some / n:
                found = np.flatnonzero(self.collisions(low, span, n) >= need)
                if len(found) >= verified or whole:
                    self.width = width
                    return found
            width *= factor

    def best(self, query: int, q: np.ndarray, k: int, share: float, verified: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best, best first; the query's own id is left out."""
        at = self.candidates(q, share, verified)
        at = at[self.ids[at] != query]
        score = self.x[at] @ q
        if len(at) > 4 * k:  # those that can't be among the best go, all ties stay
            keep = score >= np.partition(score, -k)[-k] - 1e-9 * self.longest * np.sqrt(q @ q)
            at, score = at[keep], score[keep]
        score = np.einsum("ij,j->i", self.x[at], q)
        first = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][first], score[first]


def search(rows: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", projections: int = 176, share: float = 0.8, verified: float = 0.15, least: int = 8, data_block: int = 8192, query_block: int = 4096, seed: int = 5) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every row for which is_query (over id) holds."""
    common.batches(rows.sparkSession)
    own = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks"))
    own = own.where(F.col("id").isNotNull() & valid(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).withColumn("size", F.size("v"))
    own, _ = common.stored(own, "vectors")
    count = {r["size"]: (r["n"], r["q"]) for r in own.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).collect()}  # a row for each vector length
    if not count:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, {id} long, score double")
    per = lambda x, k: F.create_map(*[F.lit(v) for s, c in count.items() for v in (s, max(1, -(-c[k] // x)))])[F.col("size")]
    nb, nq = per(data_block, 0), per(query_block, 1)
    mine = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    data = own.select("size", mine(nb, 1).alias("b"), every(nq).alias("qb"), "id", "v", F.lit(False).alias("query"))
    asked = own.where("asks").select("size", every(nb).alias("b"), mine(nq, 2).alias("qb"), "id", "v", F.lit(True).alias("query"))

    def cell(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        query = t["query"].to_numpy()
        ids, v = t["id"].to_numpy(), matrix(t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"])
        out: tuple[list, list, list] = ([], [], [])
        if query.any() and not query.all():
            order = np.argsort(common.mix64(ids[~query].view(np.uint64)))
            block = Block(ids[~query][order], v[~query][order], projections, seed)
            target = max(least * k, int(np.ceil(verified * len(order))))
            at = np.argsort(ids[query])
            for q, x in zip(ids[query][at], v[query][at], strict=True):
                got, score = block.best(q, x, k, share, target)
                out[0].append(np.full(len(got), q))
                out[1].append(got)
                out[2].append(score)
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], names=["query_id", "id", "score"])

    # A cell has about data_block rows and query_block queries.
    near = data.unionByName(asked).groupBy("size", "b", "qb").applyInArrow(cell, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")
