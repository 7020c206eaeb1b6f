"""What several operators share, besides stored tables: Arrow batches, hashing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.session import dropped as drop_stored
from gaugeworks.session import shared_dir, ship
from gaugeworks.session import stored_at as stored

__all__ = ["batches", "components", "drop_stored", "free", "shared_dir", "ship", "stored"]

#: Rows in one Arrow batch at most: texts can be long, and a worker holds a batch at a time.
BATCH_ROWS = 512


def batches(spark: SparkSession) -> None:
    """Makes a session ready for this package's Arrow functions: workers find the package, and batches
    are small; a smaller setting of the session's stays."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def free(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def widened(docs: DataFrame, told: Column, names: list[str]) -> DataFrame:
    """docs with the fields of the struct told, whatever docs' columns are called; one that has the name of a field is replaced."""
    kept = [c for c in docs.columns if c not in names]
    both = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), told.alias("told"))
    return both.select(*[F.col("row")[c].alias(c) for c in kept], *[F.col("told")[k].alias(k) for k in names])


def struct_array(kind: pa.StructType, **columns) -> pa.Array:
    """A struct array with kind's fields out of lists or arrays."""
    return pa.StructArray.from_arrays([x if isinstance(x := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f in kind], fields=list(kind))


class Remembered(dict):
    """What make(key) gave, for the keys of two generations of `most` at most each; long keys are made anew each time."""

    def __init__(self, make, most: int, longest: int = 48):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self.add(key, value)
        return value

    def add(self, key, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Edges that one task may hold: 16 MB.
SMALL_GRAPH = 1_000_000


def _forest(edges: DataFrame) -> DataFrame:
    """Components in one task, by union-find: for graphs whose size has been checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u, v = find(u), find(v)
                if u != v:
                    parent[max(u, v)] = min(u, v)
        found = [(x, find(x)) for x in parent]
        found = [x for x in found if x[0] != x[1]]
        for at in range(0, len(found), 100_000):
            u, v = zip(*found[at : at + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["node", "root"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, small: int = SMALL_GRAPH) -> tuple[DataFrame, list[str]]:
    """Connected components of the undirected edges (a, b): (node, root), root the smallest node reachable.

    Alternates two contractions until nothing changes: every node's larger neighbours, then
    its smaller ones and itself, are linked to the smallest one seen (Kiveris et al., 2014). Each
    round shuffles the edges by node with map-side minima; no neighbourhood is collected, so a node
    with very many neighbours costs rows, not memory. Every round is a table in the shared folder; the paths
    returned are still in use by the result. Edges with a null end, and a = b, add nothing. Nodes are whole numbers. A graph of `small` edges at most
    is done in one task instead, which takes fewer jobs; the result is the same.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now, path = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if now.limit(small + 1).count() <= small:
        done, new = stored(_forest(now), "roots")
        drop_stored(spark, path)
        return done, [new]
    last = None
    for _ in range(max_rounds):
        # large-star: larger neighbours of u go to min(neighbours, u)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small-star: smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after, new = stored(small, "edges")
        stat = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_stored(spark, path)
        now, path = after, new
        if stat == last:
            break
        last = stat
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")), [path]
