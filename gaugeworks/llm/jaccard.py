"""Exact Jaccard join of texts on word shingles by token-combination prefixes.

A text's set is its distinct shingles of five words; texts link when their sets' Jaccard similarity is 0.8 or more.

1. Frequencies. Every shingle of every text is counted: tasks count their own, pack sorted hashes, and reducers of hash ranges sum
   them up. Two bit maps of bounded size tell of each shingle whether it occurs again, and whether it occurs in more than
   `frequent` texts. Where a corpus fills the maps, shingles count as frequent that aren't: they are indexed in combinations then, some three times as many signatures a text, and no list grows
   for it. A wrong bit (two shingles may share one) costs time, never a result.
2. Order. Shingles that occur nowhere else come first, then rare ones, then frequent ones; by hash within a class. If a set of n shingles has
   more than n // 5 that occur nowhere else, it has no partner. The others are told apart by a 128-bit hash of the set, so that copies are one row.
3. Signatures. A partner lacks n // 5 of a set's shingles at most. A prefix of the order is extended until its rare shingles, plus over
   classes of frequent shingles the number in the class less one, exceed n // 5: then whatever a partner lacks, both prefixes share a rare
   shingle, or two shingles of a frequent class. Rare shingles are signatures alone; of frequent ones, pairs within a class
   are. Frequent classes are dealt by hash, about 4 to 8 shingles of a set in each, by the power of two that fits the set's size; a set is indexed
   for each power that a partner may have.
4. Sketches. Each set keeps the parity of its shingles in 1024 hashed bits. What two sets share cancels out, so bits that differ are never more than
   shingles that differ; a pair with more of them than a ninth of both sizes can't link and isn't formed.
5. Verification. In every signature's list, each set is compared with the smallest one first, and components are found; that is done `rounds` times, fewer where
   few pairs of differing components are left; pairs whose components still differ are compared after that, until no such pair is left. Lists of more than `hot` sets by then hold what a page frame or
   a notice joins without a link. Their sets, of all such lists together, are indexed anew: exact counts within them order each set's shingles, and the first n // 5 + 1 of them, which are the rarest there, stand for the list. What is
   long even so, texts that share nearly 0.8, is dealt to tasks by pairs of parts. Groups of near copies are so linked by about as many comparisons as they
   have members. All comparisons are exact, by whole sets.

Which pairs are compared depends on components alone: a pair that isn't compared is in one component already, so components are those of all links.

Defined results: null and empty texts, and those of white space alone, have no shingles and link with nothing; fewer words than five are one shingle. A row with a null
id gets its count and a null component, and links with nothing. Every row is in the result, repeated ones too; rows that share an id count as one node. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, KEY_BITS, FLUSH = 5, 40, 1 << 21
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingles(text: str | None, piece: int = 1 << 20) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the whole text's shingles."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    hashed, at = [], 0
    while at < len(data):
        end = min(len(data), at + piece)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        hashed.append(np.array([xxhash.xxh3_64_intdigest(w) for w in data[at:end].split()], np.uint64))
        at = end
    w = np.concatenate(hashed) if hashed else np.empty(0, np.uint64)
    if not len(w):
        return w
    if len(w) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(w.tobytes())], np.uint64)
    h = w[: len(w) - SHINGLE + 1] * MULTIPLIERS[0]
    for k in range(1, SHINGLE):
        h = h + w[k : len(w) - SHINGLE + 1 + k] * MULTIPLIERS[k]
    return np.unique(common.mix64(h))


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences, byte by byte of equal weight."""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(step.max()).bit_length() // 8))
    return bytes([width]) + step.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return np.cumsum(out.reshape(-1).view(np.uint64))


class Frequencies:
    """Bits of shingles by the first bits of their hash: again, whether it occurs more than once; many, whether in more texts than `frequent`."""

    def __init__(self, bits: int, again: np.ndarray, many: np.ndarray):
        self.bits, self.again, self.many = bits, again, many

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = h >> np.uint64(64 - self.bits)
        byte, bit = (k >> np.uint64(3)).astype(np.int64), np.uint8(7) - (k & np.uint64(7)).astype(np.uint8)
        return (self.again[byte] >> bit & 1).astype(bool), (self.many[byte] >> bit & 1).astype(bool)


def frequencies(docs: DataFrame, frequent: int, most_bits: int) -> Frequencies:
    """Counts every shingle of docs (t); the maps have a bit for two shingles each, up to 2**most_bits, the bound on what is broadcast."""
    size = docs.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    about = size // 6 + 1
    bits = min(most_bits, max(16, (about // 2).bit_length()))
    part_bits = min(bits - 6, max(4, (about >> 21).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            times = np.minimum(times, 255).astype(np.uint8)
            edge = np.searchsorted(keys, np.arange((1 << part_bits) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - part_bits))
            full = np.flatnonzero(np.diff(edge))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([pack(keys[edge[k] : edge[k + 1]]) for k in full], pa.binary()), pa.array([times[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary())], names=["part", "keys", "times"])

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append(shingles(t) >> np.uint64(64 - KEY_BITS))
                n += len(held[-1])
                if n >= FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, times = None, [], []

        def done() -> pa.RecordBatch:
            k, t = np.concatenate(keys), np.concatenate(times).astype(np.int64)
            order = np.argsort(k, kind="stable")
            k, t = k[order], t[order]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            t, k = np.add.reduceat(t, first), k[first]
            at = (k >> np.uint64(KEY_BITS - bits)).astype(np.int64) - (part << (bits - part_bits))
            maps = np.zeros((2, 1 << (bits - part_bits)), bool)
            maps[0, at[t > 1]] = True
            maps[1, at[t > frequent]] = True
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([np.packbits(m).tobytes()], pa.binary()) for m in maps)], names=["part", "again", "many"])

        for b in batches:
            for p, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part and keys:
                    yield done()
                    keys, times = [], []
                part = p
                keys.append(unpack(k))
                times.append(np.frombuffer(t, np.uint8))
        if keys:
            yield done()

    packed = docs.select("t").mapInArrow(count, "part int, keys binary, times binary")
    maps = packed.repartition(1 << part_bits, "part").sortWithinPartitions("part").mapInArrow(total, "part int, again binary, many binary")
    out = np.zeros((2, 1 << (bits - 3)), np.uint8)
    width = 1 << (bits - part_bits - 3)
    for r in maps.collect():  # 2 * 2**bits bits in all, 64 MB at most
        out[0, r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["again"], np.uint8)
        out[1, r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["many"], np.uint8)
    return Frequencies(bits, out[0], out[1])


def lacks(n: int) -> int:
    """How many of n shingles a partner may lack: 100 * shared >= 80 * united, and the union has n at least."""
    return n // 5


def power(n: int) -> int:
    """Frequent shingles of a set of n are dealt to 2**power classes."""
    return max(0, (n // 4).bit_length() - 1)


def signatures(h: np.ndarray, freq: Frequencies) -> np.ndarray:
    """Signatures of the set h, of sorted distinct hashes; none if it can't have a partner other than copies."""
    n = len(h)
    need = lacks(n) + 1
    again, many = freq.of(h)
    alone = int((~again).sum())
    if alone >= need or n < 2:
        return np.empty(0, np.uint64)
    rare = h[again & ~many]
    if alone + len(rare) >= need:
        return common.mix64(rare[: need - alone])
    out, often = [common.mix64(rare)], h[again & many]
    need -= alone + len(rare)
    low, high = (4 * n + 4) // 5, n * 5 // 4
    for p in range(power(low), power(high) + 1):
        # a class by bits that the order of hashes doesn't follow
        own = (common.mix64(often ^ np.uint64(0x5DEECE66D)) & np.uint64((1 << p) - 1)).astype(np.int64)
        counts: dict[int, list[int]] = {}
        left = need
        for k, c in enumerate(own.tolist()):
            if c in counts:
                left -= 1
                counts[c].append(k)
            else:
                counts[c] = [k]
            if not left:
                break
        a, b = [], []
        for ks in counts.values():
            for x in range(1, len(ks)):
                a += [ks[x]] * x
                b += ks[:x]
        pair = often[a] * MULTIPLIERS[0] ^ common.mix64(often[b]) * MULTIPLIERS[1]
        out.append(common.mix64(pair + np.uint64(p + 1)))
    return np.unique(np.concatenate(out))


SKETCH = 16


def sketch(h: np.ndarray) -> list[int]:
    """Parities of the shingles in 64 * SKETCH bits."""
    odd = np.bincount((h & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def may_link(a: str, b: str) -> Column:
    """Whether sketches as and bs allow a link of sets of an and bn shingles: 0.8 or more means (an + bn) / 9 that differ at most."""
    differ = sum((F.bit_count(F.get(f"{a}s", F.lit(k)).bitwiseXOR(F.get(f"{b}s", F.lit(k)))) for k in range(SKETCH)), F.lit(0))
    return 9 * differ <= F.col(f"{a}n") + F.col(f"{b}n")


def _sets(docs: DataFrame, freq) -> DataFrame:
    """(id, n, k1, k2, tokens, sketch) of every row; tokens (hashes, 8 bytes each) and sketch only where a partner or a copy is possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k1, k2, tokens, sketches = [], [], [], [], []
            for t in b.column(1).to_pylist():
                h = shingles(t)
                raw = h.tobytes()
                key = xxhash.xxh3_128_digest(raw)
                n.append(len(h))
                k1.append(int.from_bytes(key[:8], "little", signed=True))
                k2.append(int.from_bytes(key[8:], "little", signed=True))
                again, _ = freq.value.of(h)
                some = len(h) and int((~again).sum()) <= lacks(len(h))
                tokens.append(raw if some else None)
                sketches.append(sketch(h) if some else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(tokens, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "n", "k1", "k2", "tokens", "sketch"])

    return docs.select("id", "t").mapInArrow(run, "id long, n long, k1 long, k2 long, tokens binary, sketch array<long>")


def _index(sets: DataFrame, freq) -> DataFrame:
    """(sig, node, n) of each set (node, n, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [signatures(np.frombuffer(t, np.uint64), freq.value) for t in b.column(2).to_pylist()]
            times = np.array([len(s) for s in sigs])
            if times.sum():
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).astype(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), times)), pa.array(np.repeat(b.column(1).to_numpy(), times))], names=["sig", "node", "n"])

    return sets.select("node", "n", "tokens").mapInArrow(run, "sig long, node long, n long")


def _verified(pairs: DataFrame, sets: DataFrame, together: int = 256) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets link.

    A set's partners are dealt to groups of about `together`, each with a copy of the set; a group is read as a stream.
    """
    groups = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / together).cast("int").alias("groups"))
    own = sets.select("node", "tokens")
    centre = groups.join(own.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(-1).cast("long").alias("b"), F.lit(0).alias("role"), "tokens")
    dealt = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), "b", F.lit(1).alias("role"))
    others = dealt.join(own.withColumnRenamed("node", "b"), "b").select("a", "g", "b", "role", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for a, b, role, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(tokens, np.uint64)
                if role == 0:
                    held = x
                    continue
                small, large = (x, held) if len(x) < len(held) else (held, x)
                at = np.minimum(large.searchsorted(small), len(large) - 1)
                shared = int((large[at] == small).sum())
                if 100 * shared >= 80 * (len(x) + len(held) - shared):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    spark = pairs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return centre.unionByName(others).repartition(parts, "a", "g").sortWithinPartitions("a", "g", "role").select("a", "b", "role", "tokens").mapInArrow(run, "a long, b long")


def _parted(left: DataFrame, sets: DataFrame, hot: int) -> DataFrame:
    """Lists (sig, node, n, root) of more than hot sets give way to lists by single shingles, the rarest of each set among all sets in such lists; only lists of several components stay.

    Two sets that link share one of the first n // 5 + 1 shingles of either, in any one order of all shingles.
    """
    large = left.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("sig")
    large, path = common.stored(large, "large")
    if not large.limit(1).count():
        common.drop_stored(left.sparkSession, path)
        return left
    pool = left.join(large, "sig", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root")).join(sets.select("node", "tokens"), "node")

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(t, np.int64) for t in b.column(3).to_pylist()]
            times = np.array([len(x) for x in own], np.int64)
            if len(own):
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(np.repeat(np.arange(len(own)), times))) for k in range(3)), pa.array(np.concatenate(own))], names=["node", "n", "root", "token"])

    tokens, _ = common.stored(pool.select("node", "n", "root", "tokens").mapInArrow(every, "node long, n long, root long, token long"), "tokens")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("c", "token"))
    first = tokens.join(counts, "token").withColumn("place", place).where((F.col("place") <= F.expr("n div 5 + 1")) & (F.col("c") > 1))
    again = first.select(F.xxhash64(F.lit("hot"), "token").alias("sig"), "node", "n", "root")
    again, _ = common.stored(again, "again")
    mixed = again.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    return left.join(large, "sig", "left_anti").unionByName(again.join(mixed, "sig", "left_semi"))


def _links(sets: DataFrame, lists: DataFrame, rounds: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """(links, roots): enough links for the components of all, and these. lists: (sig, node, n, a, an), two nodes or more in each, a the smallest."""
    spark = sets.sparkSession
    fits = (F.col("an") * 4 <= F.col("bn") * 5) & (F.col("bn") * 4 <= F.col("an") * 5)
    links = roots = done = None
    left, left_path = lists, None
    for step in range(rounds + 1):
        if step:
            now = left.join(roots, "node", "left").select("sig", "node", "n", F.coalesce("root", "node").alias("root"))
            mixed = now.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
            now = now.join(mixed, "sig", "left_semi")
            now, path = common.stored(now, "left")
            if left_path:
                common.drop_stored(spark, left_path)
            left_path = path
            # pairs of differing components that are left
            by = now.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("sig").agg(F.sum("c").alias("g"), F.sum(F.col("c") * F.col("c")).alias("q"))
            some, sets_left = by.agg(F.sum((F.col("g") * F.col("g") - F.col("q")) / 2), F.sum("g")).first()
            if not some:
                break
            if step == rounds or some <= 4 * sets_left:
                now = _parted(now, sets, hot)
                # a list that is long even so is dealt to tasks by pairs of parts of `hot` sets each
                long = now.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / hot).alias("parts")).where("parts > 1")
                drawn = now.join(long, "sig", "left").join(sets.select("node", "sketch"), "node").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
                drawn = drawn.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
                drawn = drawn.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
                # parts bound a task's work: split further for skew, by the square of a part's size, these joins would be thousands of tasks, all kept by the driver
                drawn = drawn.repartition("sig", "p", "q")
                a, b = (drawn.select("sig", "p", "q", F.col("node").alias(x), F.col("n").alias(f"{x}n"), F.col("root").alias(f"{x}r"), F.col("sketch").alias(f"{x}s")) for x in "ab")
                pairs = a.join(b, (a["sig"] == b["sig"]) & (a["p"] == b["p"]) & (a["q"] == b["q"]) & (F.col("a") < F.col("b")) & (F.col("ar") != F.col("br")) & fits & may_link("a", "b")).select("a", "b").distinct()
                pairs, _ = common.stored(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
                common.free(spark)
                found, _ = common.stored(_verified(pairs, sets), "found")
                if found.limit(1).count():
                    links = links.unionByName(found)
                    roots, _ = common.components(links)
                break
        # each list's sets against its smallest one, which is then through with this list
        if step == 0:
            star = left.select("a", "an", F.col("a").alias("ar"), F.col("node").alias("b"), F.col("n").alias("bn"), F.col("node").alias("br"))
        else:
            pivot = now.groupBy("sig").agg(F.min(F.struct("node", "n", "root")).alias("p")).select("sig", F.col("p.node").alias("a"), F.col("p.n").alias("an"), F.col("p.root").alias("ar"))
            now = now.join(pivot, "sig")
            star = now.select("a", "an", "ar", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("root").alias("br"))
        pairs = star.where((F.col("a") != F.col("b")) & (F.col("ar") != F.col("br")) & fits).select("a", "b").distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs, _ = common.stored(pairs, "pairs")
        found, _ = common.stored(_verified(pairs, sets), "found")
        done = pairs if done is None else done.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        roots, _ = common.components(links)
        left = (left if step == 0 else now).where("node <> a").select("sig", "node", "n")
        common.free(spark)
    return links, roots


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", frequent: int = 32, most_bits: int = 28, rounds: int = 1, hot: int = 2048) -> DataFrame:
    """(id, n_shingles, component_id) of every row of docs.

    frequent: the texts beyond which a shingle is frequent, whatever the corpus' size; most_bits: the bound on the maps; hot: sets of a list beyond which it is indexed anew; below about twice the shingles of a set, pairs are cheaper.
    """
    spark = docs.sparkSession
    common.batches(spark)
    own = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    freq = spark.sparkContext.broadcast(frequencies(own, frequent, most_bits))  # 2 * 2**most_bits bits at most
    common.free(spark)
    every, every_path = common.stored(_sets(own, freq), "sets")
    names, _ = common.stored(every.select("id", "n", "k1", "k2"), "names")
    # one row for each set that may have a partner, under its smallest id
    some = every.where("tokens is not null and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    sets, _ = common.stored(some.select("node", "n", "tokens", "sketch"), "distinct")
    common.drop_stored(spark, every_path)
    common.free(spark)
    index, index_path = common.stored(_index(sets, freq), "index")
    first = index.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.min_by("n", "node").alias("an")).where("a < z").select("sig", "a", "an")
    lists, _ = common.stored(index.join(first, "sig"), "lists")
    common.drop_stored(spark, index_path)
    common.free(spark)
    _, roots = _links(sets, lists, rounds, hot)
    freq.unpersist()
    first = names.where("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("node")).join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("component"))
    out = names.join(first, ["k1", "k2"], "left")
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))).alias("component_id"))
