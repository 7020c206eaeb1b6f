"""Near-duplicate vectors by sorted projection passes.

Equal vectors are one class first, so that any number of copies is one row. A pass gives each class a key, the signs of 64 random
projections of what it has beside the mean of its label, so that keys part a label evenly, narrow or wide, and orders the classes of all labels by (label, length, key), lexicographically. The order is cut into blocks of `window` rows, and each row is
compared with its own block, the one before and the one after, across the borders of tasks too. Pairs at the threshold or above are links, and links of all passes
are united. A row keeps its block of every pass: a pair counts in the first pass that compares it and never again, so that counts add up, and
no pair becomes a row: what leaves a comparison are counts, and links that join classes for the first time.

A label has so many passes that a pair at the threshold is missed with a probability well below `missed` where its rows lie evenly around its mean; the number grows slowly with
the label, and with how near its rows are to the mean, beside which a pair at the threshold is then farther apart. A label that fits one window has one pass. Where rows don't lie so, as in a group of more near vectors than a block has, windows are narrow for what they must hold. So each row adds up, over passes, the chance
that a partner at the threshold lay outside: it must have agreed with the row in fewer leading signs than the window covers, and how likely a sign agrees follows from the row's own distance to the mean. Rows above `missed` are
compared with all rows of their label, block by block, without the pairs that a pass has compared: that is the exact way for saturated windows. Its work
is the number of such rows times the rows of their labels.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, and rows with a null label or id link with nothing:
n_links 0, component their own id. Vectors of different lengths never link. Repeated rows (same id, label and
vector) are one row of the result. Columns other than those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a tile; doubt about products in single precision; signs in a key; blocks that a task compares in one go.
TILE, DOUBT, SIGNS, TOGETHER = 1024, 1e-4, 64, 8
#: Blocks of the exact way: about so many to a label, while they stay below the bytes.
MOST, BLOCK_BYTES = 32, 1 << 26
#: Passes of a label at most; the exact way has what they leave in doubt.
MOST_PASSES = 128


def valid(v: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that isn't zero."""
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~wrong & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have one length as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True, initial=5e-324)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def units(raw: list[bytes], size: int) -> np.ndarray:
    """Unit vectors out of packed ones, in double precision."""
    out = np.empty((len(raw), size))
    width = np.array([len(r) for r in raw])
    for kind in (np.float32, np.float64):
        own = np.flatnonzero(width == size * kind().itemsize)
        out[own] = np.frombuffer(b"".join([raw[k] for k in own]), kind).reshape(len(own), size)
    return normal(out)


def agreement(threshold: float, apart: np.ndarray | float = 1.0) -> np.ndarray:
    """The least probability that a random projection's sign is the same for a unit vector that is `apart` from the mean and any partner at the threshold: their
    difference is at most sqrt(2 - 2 threshold), which seen from the mean is an angle of at most its arc sine over the distance."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    apart = np.asarray(apart, float)
    return np.where(apart > reach, 1 - np.arcsin(np.minimum(1.0, reach / np.maximum(apart, 1e-300))) / math.pi, 0.0)


def passes(rows: int, window: int, chance: float, missed: float) -> int:
    """Passes after which a pair whose signs agree with that chance is missed with a probability of missed at most, if rows lie evenly."""
    if rows <= window:
        return 1
    found = min(1 - 1e-9, chance ** (math.log2(rows / window) + 1))
    return math.ceil(math.log(missed) / math.log1p(-found)) if found > 1e-9 else MOST_PASSES


@lru_cache(2)
def directions(size: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, SIGNS * count), np.float32)


def leading(x: np.ndarray) -> np.ndarray:
    """How many leading bits of 64 are zero."""
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = lambda v: np.frexp(v)[1]  # 0 for 0; exact, as 32 bits fit a double
    return np.where(high > 0, 32 - bits(high), 64 - bits(low))


class Rows:
    """Rows to compare: ids, members, unit vectors, and for each row its blocks of some passes."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, x: np.ndarray, blocks: np.ndarray):
        self.ids, self.n, self.x, self.low, self.blocks = ids, n.astype(np.float64), x, x.astype(np.float32), blocks


def product(one: Rows, two: Rows, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of two sets of rows: the linked members of each row on either side, and a forest of links.

    same: two is one; each pair counts once then, for both of its rows. Pairs in equal or neighbouring blocks of any pass listed are left out.
    """
    more, others = np.zeros(len(one.x)), np.zeros(len(two.x))
    parent: list[int] = list(range(len(one.x) if same else len(one.x) + len(two.x)))
    shift, forest = 0 if same else len(one.x), []

    def find(k: int) -> int:
        while (p := parent[k]) != k:
            parent[k] = k = parent[p]
        return k

    for at in range(0, len(one.x), TILE):
        for to in range(at if same else 0, len(two.x), TILE):
            f = one.low[at : at + TILE] @ two.low[to : to + TILE].T
            near = f >= threshold - DOUBT
            if same and at == to:
                near = np.triu(near, 1)
            if not near.any():
                continue
            near &= one.ids[at : at + TILE, None] != two.ids[to : to + TILE]  # an id with several vectors
            met = [(p[at : at + TILE], q[to : to + TILE]) for p, q in zip(one.blocks.T, two.blocks.T, strict=True)]
            if 16 * np.count_nonzero(near) < near.size:
                i, j = np.nonzero(near)
                for p, q in met:
                    near[i, j] &= np.abs(p[i] - q[j]) > 1
            else:
                for p, q in met:
                    if p.min() <= q.max() + 1 and q.min() <= p.max() + 1:
                        near &= np.abs(p[:, None] - q) > 1
            i, j = np.nonzero(near & (f < threshold + DOUBT))
            for k in range(0, len(i), 1 << 16):
                u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                near[u, v] = np.einsum("ij,ij->i", one.x[at + u], two.x[to + v]) >= threshold
            whole = near.astype(np.float64)
            more[at : at + TILE] += whole @ two.n[to : to + TILE]
            (more if same else others)[to : to + TILE] += one.n[at : at + TILE] @ whole
            while True:  # one link a row out of its component, until none is left
                a, b = (np.array([find(k) for k in range(low_k, low_k + size)]) for low_k, size in ((at, near.shape[0]), (shift + to, near.shape[1])))
                out = near & (a[:, None] != b)
                first = out.argmax(1)
                rows = np.flatnonzero(out[np.arange(len(first)), first])
                if not len(rows):
                    break
                for u, v in zip((at + rows).tolist(), (to + first[rows]).tolist(), strict=True):
                    p, q = find(u), find(shift + v)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        forest.append((int(one.ids[u]), int(two.ids[v])))
    return more, others, forest


FOUND = "a long, b long, more long, out double"


def _found(a: np.ndarray, more: np.ndarray, out: np.ndarray, forest: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows (a, null, more, out) for counts, and (a, b, null, null) for links."""
    names = ["a", "b", "more", "out"]
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(more.astype(np.int64)), pa.array(out, pa.float64())], names=names)
    u, v = np.array(forest, np.int64).reshape(-1, 2).T
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.float64())], names=names)


def _centres(classes: DataFrame, window: int, threshold: float, missed: float, least: int) -> DataFrame:
    """(label, size, centre, passes): the mean of each label's unit vectors, and how many passes it has, by its rows and their distance from the mean."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.table([b.column(0), pa.array([len(x) for x in b.column(1)], pa.int32())], names=["label", "size"])
            coded = {k: i for i, k in enumerate(dict.fromkeys(zip(*keys.to_pydict().values(), strict=True)))}
            of = np.array([coded[k] for k in zip(*keys.to_pydict().values(), strict=True)])
            for (label, size), i in coded.items():
                x = normal(matrix(b.column(1).take(pa.array(np.flatnonzero(of == i)))))
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([size], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.sum(0).tolist()], pa.list_(pa.float64()))], names=["label", "size", "n", "sums"])

    part = classes.select("label", "v").mapInArrow(sums, "label string, size int, n long, sums array<double>").select("label", "size", "n", F.posexplode("sums").alias("j", "s"))
    part = part.groupBy("label", "size", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    means = part.groupBy("label", "size").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", (F.col("s") / F.col("n")).alias("c")))), lambda x: x.c).alias("centre"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                chance = float(agreement(threshold, math.sqrt(max(0.0, 1 - sum(x * x for x in c)))))  # at the distance of the mean row
                need = passes(n, window, chance, missed)
                # where all rows may be partners more passes don't help
                out.append(1 if n <= window else least if chance < 0.55 else min(MOST_PASSES, max(least, need)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(out, pa.int32())], names=["label", "size", "centre", "passes"])

    return means.select("label", "size", "n", "centre").mapInArrow(count, "label string, size int, centre array<double>, passes int")


def _keyed(classes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """(rep, label, size, n, raw, chance, keys) of classes (rep, label, v, n, centre, passes): raw, the vector packed in as few bytes as hold it exactly; chance, that of a sign to agree; keys, one for each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = np.array([(len(x), k) for x, k in zip(b.column(2), b.column(5).to_pylist(), strict=True)]).reshape(-1, 2)
            for size, count in np.unique(kinds, axis=0).tolist():
                rows = b.take(pa.array(np.flatnonzero((kinds == (size, count)).all(1))))
                x = matrix(rows.column(2))
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                raw = [s.tobytes() if k else r.tobytes() for k, s, r in zip((short == x).all(1).tolist(), short, x, strict=True)]
                beside = normal(x) - matrix(rows.column(4))
                chance = agreement(threshold, np.sqrt((beside * beside).sum(1)))
                signs = beside.astype(np.float32) @ directions(size, MOST_PASSES, seed)[:, : SIGNS * count] >= 0
                keys = np.packbits(signs, axis=1).view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)  # in the order of signed numbers
                keys = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1).view(np.int64)), count).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(len(x), size), pa.int32()), rows.column(3), pa.array(raw, pa.binary()), pa.array(chance), keys], names=["rep", "label", "size", "n", "raw", "chance", "keys"])

    return classes.select("rep", "label", "v", "n", "centre", "passes").mapInArrow(run, "rep long, label string, size int, n long, raw binary, chance double, keys array<long>")


def _placed(keyed: DataFrame, window: int) -> DataFrame:
    """keyed with places, one for each pass: the row's place in the order of all passes' rows; and blocks, which they lie in."""
    spark = keyed.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["pass", "label", "size", "key", "rep"]
    # hashes stand for labels beside the sort: rows without vectors are ordered
    rows = keyed.select("rep", "label", "size", F.posexplode("keys").alias("pass", "key"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("rep", "pass", F.monotonically_increasing_id().alias("m"))
    ordered, _ = common.stored(ordered, "order")
    task = F.shiftright("m", 33)
    sizes = sorted(tuple(r) for r in ordered.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each task
    before, total = [], 0
    for t, n in sizes:
        before.append((t, total))
        total += n
    start = F.broadcast(spark.createDataFrame(before, "t long, start long"))  # a row for each task
    at = ordered.join(start, task == F.col("t")).select("rep", F.struct("pass", (F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1)).alias("at")).alias("p"))
    places = at.groupBy("rep").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.at).alias("places"))  # as many as passes
    return keyed.join(places, "rep").withColumn("blocks", F.transform("places", lambda p: F.floor(p / window).cast("int")))


def _passes(placed: DataFrame, window: int, threshold: float) -> DataFrame:
    """FOUND of all passes: counts and links, and in `out` the logarithm of the chance that a pass left a partner of a row outside."""
    group = window * TOGETHER
    rows = placed.select("rep", "label", "size", "n", "raw", "chance", "blocks", F.posexplode(F.arrays_zip("keys", "places")).alias("pass", "own")).select("*", F.col("own.keys").alias("key"), F.col("own.places").alias("at")).drop("own")
    rows = rows.withColumn("blocks", F.slice("blocks", F.lit(1), F.col("pass")))  # those of the passes before
    block, g = F.floor(F.col("at") / window), F.floor(F.col("at") / group)
    # a group has its rows, the block before them, and the last row of the block after
    last = block % TOGETHER == TOGETHER - 1
    first = (block % TOGETHER == 0) & (F.col("at") % window == window - 1) & (g > 0)
    rows = rows.withColumn("g", F.explode(F.when(last, F.array(g, g + 1)).when(first, F.array(g, g - 1)).otherwise(F.array(g))))

    def whole(g: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        at, rep, number_of, n, key, chances = (rows[c].to_numpy() for c in ("at", "rep", "pass", "n", "key", "chance"))
        label, size_of = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["size"].to_numpy()
        key, block = key.view(np.uint64), at // window
        inside = block // TOGETHER == g
        more, out, forest = np.zeros(len(rows)), np.zeros(len(rows)), []
        change = (np.flatnonzero((np.diff(number_of) != 0) | (np.diff(label) != 0) | (np.diff(size_of) != 0)) + 1).tolist()
        for low, high in zip([0, *change], [*change, len(rows)], strict=True):  # rows of one pass, label and length
            if not inside[low:high].any():
                continue
            until = low + int(np.flatnonzero(inside[low:high])[-1]) + 1
            own, number, size = rows.slice(low, until - low), int(number_of[low]), int(size_of[low])
            x = units(own["raw"].to_pylist(), size)
            blocks = pa.concat_arrays(c.flatten() for c in own["blocks"].chunks).to_numpy().reshape(until - low, number).astype(np.int64)
            chance = chances[low:until]
            cuts = [low, *(low + 1 + np.flatnonzero(np.diff(block[low:until]))).tolist(), until]
            held = None
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = Rows(rep[a:b], n[a:b], x[a - low : b - low], blocks[a - low : b - low])
                if held is not None:
                    m, o, f = product(held[0], now, False, threshold)
                    more[held[1] : a] += m
                    more[a:b] += o
                    forest += f
                held = now, a
                if not inside[a]:
                    continue
                m, _, f = product(now, now, True, threshold)
                more[a:b] += m
                forest += f
                known = np.full(b - a, -1)  # leading signs that rows outside may share
                for place in ((block[a] - 1) * window, (block[a] + 2) * window - 1):
                    k = int(np.searchsorted(at, place))
                    if low <= k < high and at[k] == place:  # else the window holds all on this side
                        known = np.maximum(known, leading(key[a:b] ^ key[k]))
                within = np.where(known < SIGNS, chance[a - low : b - low] ** (known + 1.0), 0.0)
                out[a:b] = np.log1p(-np.minimum(within, 1 - 1e-16))
                out[a:b][known < 0] = -50.0
        told = inside | (more > 0)
        yield from _found(rep[told], more[told], out[told], forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            g = b.column(0).to_numpy()
            for low, high in pairwise([0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)] if len(g) else [0]):
                if g[low] != now:
                    if held:
                        yield from whole(now, pa.Table.from_batches(held))
                    now, held = int(g[low]), []
                held.append(b.slice(low, high - low))
        if held:
            yield from whole(now, pa.Table.from_batches(held))

    parts = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("g", "at", "rep", "pass", "label", "size", "n", "key", "raw", "blocks", "chance").repartition(parts, "g").sortWithinPartitions("g", "at")
    return dealt.mapInArrow(run, FOUND)


def _rest(placed: DataFrame, unsafe: DataFrame, window: int, threshold: float, seed: int) -> DataFrame:
    """FOUND of the pairs that no pass compared and that have a row of unsafe (rep)."""
    marked = placed.drop("keys", "places", "chance").join(unsafe.select("rep", F.lit(True).alias("unsafe")), "rep", "left").withColumn("unsafe", F.coalesce("unsafe", F.lit(False)))
    marked, _ = common.stored(marked, "marked")
    # rows of a block: so many blocks to a label as MOST says, unless they'd be small or large
    fits = F.greatest(F.lit(4 * window), F.least(F.ceil(F.col("all") / MOST), F.floor(BLOCK_BYTES / (8 * F.col("size")))))
    sizes = marked.groupBy("label", "size").agg(F.count(F.lit(1)).alias("all"), F.count_if("unsafe").alias("u")).where("u > 0")
    sizes, _ = common.stored(sizes.select("label", "size", F.ceil(F.col("u") / fits).cast("int").alias("nu"), F.ceil(F.col("all") / fits).cast("int").alias("na")), "sizes")
    dealt = marked.join(sizes, ["label", "size"])
    own = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(seed + salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ask = dealt.where("unsafe").withColumn("p", own("nu", 1)).withColumn("q", every("na")).withColumn("side", F.lit(0))
    told = dealt.withColumn("q", own("na", 2)).withColumn("p", every("nu")).withColumn("side", F.lit(1))
    cells = ask.unionByName(told).select("label", "size", "p", "q", "side", "rep", "n", "unsafe", "raw", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = None, ([], [])

        def done() -> Iterator[pa.RecordBatch]:
            if not all(sides):
                return
            one, two = (Rows(np.array([r[0] for r in s], np.int64), np.array([r[1] for r in s]), units([r[3] for r in s], cell[1]), np.array([r[4] for r in s], np.int64).reshape(len(s), -1)) for s in sides)
            more, others, forest = product(one, two, False, threshold)
            others[np.array([r[2] for r in sides[1]])] = 0  # these ask themselves
            a, m = np.concatenate([one.ids[more > 0], two.ids[others > 0]]), np.concatenate([more[more > 0], others[others > 0]])
            yield from _found(a, m, np.zeros(len(a)), forest)

        for batch in batches:
            for label, size, p, q, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (label, size, p, q) != cell:
                    if cell:
                        yield from done()
                    cell, sides = (label, size, p, q), ([], [])
                sides[side].append(row)
        if cell:
            yield from done()

    parts = max(1, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartition(parts, "label", "size", "p", "q").sortWithinPartitions("label", "size", "p", "q").mapInArrow(run, FOUND)


def links(classes: DataFrame, threshold: float, window: int, missed: float, least_passes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of classes (rep, label, v, n), n their members: (a, b), links that join all that is linked, and (rep, more), the members of other
    classes that rep links with."""
    spark = classes.sparkSession
    common.batches(spark)
    centres, centres_path = common.stored(_centres(classes, window, threshold, missed / 5, least_passes), "centres")
    keyed, keyed_path = common.stored(_keyed(classes.withColumn("size", F.size("v")).join(centres, ["label", "size"]), threshold, seed), "keyed")
    placed, placed_path = common.stored(_placed(keyed, window), "placed")
    common.drop_stored(spark, keyed_path, centres_path)
    found, _ = common.stored(_passes(placed, window, threshold), "found")
    unsafe = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("out").alias("out")).where(F.col("out") > math.log(missed))
    unsafe, _ = common.stored(unsafe.select("rep"), "unsafe")
    if unsafe.limit(1).count():
        rest, _ = common.stored(_rest(placed, unsafe, window, threshold, seed), "rest")
        found = found.unionByName(rest)
    common.drop_stored(spark, placed_path)
    return found.where("b is not null").select("a", "b"), found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("more").alias("more"))


def deduplicate(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, window: int = 512, missed: float = 0.01, least_passes: int = 16, seed: int = 11) -> DataFrame:
    """(id, n_links, component_id, kept) for each vector.

    window: rows of a block; missed: the bound on the chance that a pair right at the threshold isn't compared; least_passes: passes at least.
    """
    own = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    own = own.withColumn("takes_part", valid(F.col("v")) & F.col("id").isNotNull() & F.col("label").isNotNull())
    # two 64-bit hashes name a class
    own = own.withColumn("k1", F.xxhash64("label", "v")).withColumn("k2", F.xxhash64(F.lit(seed), "v", "label"))
    members = own.where("takes_part").select("id", "k1", "k2").distinct()
    classes = own.where("takes_part").groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    sizes, _ = common.stored(members.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "sizes")
    classes, _ = common.stored(classes.join(sizes, ["k1", "k2"]).select("rep", "label", "v", "n"), "classes")
    joined, degree = links(classes, threshold, window, missed, least_passes, seed)
    roots, _ = common.components(joined)
    of_class = sizes.join(degree, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    # a table, so that a class with very many members can be split in the join
    of_class, _ = common.stored(of_class.select("k1", "k2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "classes")
    linked = members.join(of_class, ["k1", "k2"]).select("id", "n_links", "component_id")
    rest = own.where("not takes_part").select("id", "k1", "k2").distinct().select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.select(F.col("id").alias(id), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
