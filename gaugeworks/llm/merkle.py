"""Merkle manifest of a table: a tree of runs of ARITY for each group, and one over the groups' roots.

Leaves are hashes of rows, made in one projection. In a group they ascend by key; while more than one node is left, every ARITY consecutive
ones (the last run: fewer, even one) become the hash of their concatenated hexadecimal digests. What is left is the group's root, and these, in order of groups (null first), are the
leaves of the tree above.

The trees are built as a monoid. A forest is a sparse set of nodes keyed by (tree, level, index); as the numbers of leaves are known, so is
the arity of each run, the last one too. Uniting two forests resolves each run that is complete, again and again. A range of
the order gives a forest with a few open nodes at its ends, whatever its size; forests are united FAN_IN at a time, level by level, each level a table, until one is left, which is the root. Open nodes
of ranges, and nodes made where forests meet, are what ranges have to know of each other: each range gets those beside its paths to the root, and gives its rows their proofs.

Rows are shuffled as hashes, without texts: once into ranges of about `rows` leaves, and twice by range. Ranges are cut by (group, key, hash, draw): a group with most rows, a null
key and equal rows spread over many. No task holds more than a range, or the open nodes of FAN_IN forests.

Defined results: rows with equal keys ascend by their hashes; a null key comes first; a null column is `-`; an empty table gives an empty result. Of rows that are equal in all
columns each is a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

ARITY, FAN_IN = 8, 16
NODE = "part long, tree long, level int, idx long, hash binary, n long, trees long, made boolean, open boolean"
#: The tree over groups.
TOP = -1


def field(c: Column) -> Column:
    """`-` if null, else its length in UTF-8 bytes, `:`, and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def joined(digests: list[bytes]) -> bytes:
    """The node over digests; as hexadecimal digits."""
    return hashlib.sha256(b"".join(digests)).hexdigest().encode()


def widths(n: int) -> list[int]:
    """How many nodes a tree of n leaves has at each level."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


def unite(forest: dict[tuple[int, int, int], bytes], sizes: dict[int, int], trees: int) -> tuple[dict, dict]:
    """Resolves complete runs of a forest (hexadecimal digests by tree, level and index): what is open, and what was made.

    sizes: leaves by tree. A tree's root is a leaf of TOP, at the tree's number. Associative: forests may be united in any order.
    """
    open_, made = dict(forest), {}
    width = {t: widths(n) for t, n in (sizes | {TOP: trees}).items()}
    runs: dict[tuple[int, int, int], int] = {}
    todo = list(open_)
    while todo:
        t, level, k = todo.pop()
        w = width[t]
        if level == len(w) - 1:
            if t != TOP:
                value = open_.pop((t, level, k))
                open_[TOP, 0, t] = made[TOP, 0, t] = value
                todo.append((TOP, 0, t))
            continue
        run = (t, level, k // ARITY)
        runs[run] = runs.get(run, 0) + 1
        first = k // ARITY * ARITY
        if runs[run] == min(ARITY, w[level] - first):
            new = (t, level + 1, k // ARITY)
            open_[new] = made[new] = joined([open_.pop((t, level, x)) for x in range(first, first + runs[run])])
            todo.append(new)
    return open_, made


def _nodes(part: int, open_: dict, made: dict, sizes: dict[int, int], trees: int, all_made: bool) -> pa.Table:
    """Open nodes, and those made that are no longer open if asked for."""
    keys = [*open_, *(k for k in made if all_made and k not in open_)]
    hashes = [bytes.fromhex((open_.get(k) or made[k]).decode()) for k in keys]
    values = [[part] * len(keys), [k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], hashes, [sizes.get(k[0], 0) for k in keys], [trees] * len(keys), [k in made for k in keys], [k in open_ for k in keys]]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    return pa.table([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "tree", "level", "idx", "hash", "n", "trees", "made", "open"])


def _hex(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _range_forest(left: pa.Table, right: pa.Table) -> pa.Table:
    """The forest of a range: leaves in order, and where each tree's stand (tree, start, count, n, trees)."""
    hashes, at, forest, sizes = _hex(left.sort_by("at")["leaf"]), 0, {}, {}
    places = right.sort_by("tree").to_pylist()
    for p in places:
        forest |= {(p["tree"], 0, p["start"] + k): hashes[at + k] for k in range(p["count"])}
        at, sizes[p["tree"]] = at + p["count"], p["n"]
    return _nodes(places[0]["part"], *unite(forest, sizes, places[0]["trees"]), sizes, places[0]["trees"], False)


def _union_of_forests(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    sizes, trees = {r["tree"]: r["n"] for r in rows if r["tree"] != TOP}, rows[0]["trees"]
    return _nodes(rows[0]["part"], *unite({(r["tree"], r["level"], r["idx"]): r["hash"].hex().encode() for r in rows}, sizes, trees), sizes, trees, True)


def _proofs(key: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a range: its leaves, their places, and the nodes beside its paths; gives each row its proof and what its leaf, changed or not, folds to."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("at"), right.to_pylist()
        hashes, changed = _hex(left["leaf"]), left["changed"].to_pylist()
        places = sorted((r for r in right if r["count"] is not None), key=lambda r: r["tree"])
        known = {(r["tree"], r["level"], r["idx"]): r["hash"].hex().encode() for r in right if r["count"] is None}
        trees = places[0]["trees"]
        at = 0
        for p in places:
            known |= {(p["tree"], 0, p["start"] + k): hashes[at + k] for k in range(p["count"])}
            at += p["count"]
        sizes = {p["tree"]: p["n"] for p in places}
        local = {k: v for k, v in known.items() if k[1] == 0 and k[0] in sizes}
        known |= unite(local, sizes, trees)[1]
        width = {t: widths(n) for t, n in (sizes | {TOP: trees}).items()}
        paths: dict[tuple[int, int, int], tuple[bytes, list]] = {}

        def path(t: int, level: int, k: int) -> tuple[bytes, list]:
            """Siblings from a node up, joined, and the pieces beside it at each level."""
            if (t, level, k) not in paths:
                w = width[t]
                if level == len(w) - 1:
                    paths[t, level, k] = path(TOP, 0, t) if t != TOP else (b"", [])
                else:
                    first = k // ARITY * ARITY
                    run = [known[t, level, x] for x in range(first, min(first + ARITY, w[level]))]
                    before, after = b"".join(run[: k - first]), b"".join(run[k - first + 1 :])
                    more, steps = path(t, level + 1, k // ARITY)
                    paths[t, level, k] = (before + after + more, [(before, after), *steps])
            return paths[t, level, k]

        def fold(value: bytes, steps: list) -> bytes:
            for before, after in steps:
                value = joined([before, value, after])
            return value

        top, out, at = known[TOP, len(width[TOP]) - 1, 0], [], 0
        for p in places:
            t = p["tree"]
            subroot = known.get((t, len(width[t]) - 1, 0)) or known[TOP, 0, t]
            for k in range(p["count"]):
                own = hashes[at] if changed[at] is None else changed[at].hex().encode()
                beside, steps = path(t, 0, p["start"] + k)
                del paths[t, 0, p["start"] + k]  # a leaf's path is used once
                out.append((subroot.decode(), hashlib.sha256(beside).hexdigest(), fold(own, steps).decode()))
                at += 1
        text = lambda values: pa.array(values, pa.string())
        folded = [x[2] for x in out]
        root = top.decode()
        return pa.table([left[key], text([h.decode() for h in hashes]), text([x[0] for x in out]), text([root] * len(out)), text([x[1] for x in out]), text(folded), pa.array([x == root for x in folded], pa.bool_())], names=[key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def forests(ordered: DataFrame, places: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """All nodes that ranges show each other, and the last forest: the root alone. A tree of unions, FAN_IN forests at a time."""
    now, _ = common.stored(ordered.select("part", "leaf", "at").groupBy("part").cogroup(places.groupBy("part")).applyInArrow(_range_forest, NODE), "forest")
    nodes = now.where("open")
    while parts > 1:
        parts = -(-parts // FAN_IN)
        now, _ = common.stored(now.where("open").withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(_union_of_forests, NODE), "forest")
        nodes = nodes.unionByName(now.where("made"))
    return nodes, now.where("open")


def manifest(rows: DataFrame, columns: list[str], key: str, group: str, changed: dict[str, Column] | None = None, when: Column | None = None, rows_a_range: int = 1 << 15) -> DataFrame:
    """A row for each of rows: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    columns: what a leaf holds, in this order. changed: columns as they are after tampering, in rows where `when` holds; folded_root
    is what such a leaf, or the row's own, and the original siblings give, and verified tells whether that is the root.
    """
    spark = rows.sparkSession
    common.batches(spark)
    own = leaf([F.col(c) for c in columns])
    other = F.when(F.coalesce(when, F.lit(False)), leaf([(changed or {}).get(c, F.col(c)) for c in columns])) if when is not None else F.lit(None).cast("binary")
    hashed = rows.select(F.col(key).alias("__key"), F.col(group).alias("__group"), own.alias("leaf"), other.alias("changed"), F.xxhash64(F.monotonically_increasing_id()).alias("draw"))
    hashed, used = common.stored(hashed, "leaves")
    parts = max(1, -(-hashed.count() // rows_a_range))
    order = [F.col("__group").asc_nulls_first(), F.col("__key").asc_nulls_first(), F.col("leaf"), F.col("draw")]
    ranged = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered, _ = common.stored(ranged.select("__key", "__group", "leaf", "changed", "at", F.shiftright("at", 33).alias("part")), "ordered-leaves")
    common.drop_stored(spark, used)
    places = ordered.groupBy("part", "__group").agg(F.count(F.lit(1)).alias("count"))
    here = Window.partitionBy("__group")
    places = places.withColumns({"n": F.sum("count").over(here), "start": F.sum("count").over(here.orderBy("part")) - F.col("count")})
    trees = places.groupBy("__group").agg(F.count(F.lit(1))).select(F.col("__group").alias("__g"), (F.row_number().over(Window.partitionBy().orderBy(F.col("__group").asc_nulls_first())) - 1).cast("long").alias("tree"), F.count(F.lit(1)).over(Window.partitionBy()).alias("trees"))
    places = places.join(trees, F.col("__group").eqNullSafe(F.col("__g"))).select("part", "tree", "start", "count", "n", "trees")
    places, _ = common.stored(places, "leaf-places")
    ranges = places.agg(F.max("part")).first()[0]  # as many as were made, whatever was asked for
    nodes, _ = forests(ordered, places, 0 if ranges is None else ranges + 1)
    # beside a range's paths: the runs over its first and last leaf at each level, those of its trees in the tree over groups, and the root
    above = lambda x, level: F.expr(f"{x} div cast(power({ARITY}, {level}) as long)")
    levels = lambda n: F.expr(f"sequence(1, 2 + cast(ceil(log({ARITY}, {n})) as int))")  # noqa: E731  one more than there are, so that rounding lacks none
    wanted = places.select("part", "tree", "start", F.expr("start + count - 1").alias("end"), F.explode(levels("n")).alias("up"))
    wanted = wanted.select("part", "tree", "up", F.explode(F.array(above("start", "up"), above("end", "up"))).alias("over"))
    wide = places.select("part", F.col("tree").alias("start"), F.explode(levels("trees")).alias("up")).select("part", F.lit(TOP).cast("long").alias("tree"), "up", above("start", "up").alias("over"))
    asked = wanted.unionByName(wide).distinct()
    up = nodes.select("tree", (F.col("level") + 1).alias("up"), F.expr(f"idx div {ARITY}").alias("over"), "level", "idx", "hash")
    beside = asked.join(up, ["tree", "up", "over"]).select("part", "tree", "level", "idx", "hash", *[F.lit(None).cast("long").alias(c) for c in ("start", "count", "n", "trees")])
    known = beside.unionByName(places.withColumns({"level": F.lit(None).cast("int"), "idx": F.lit(None).cast("long"), "hash": F.lit(None).cast("binary")}))
    kind = ordered.schema["__key"].dataType.simpleString()
    out = ordered.select("part", "__key", "leaf", "changed", "at").groupBy("part").cogroup(known.groupBy("part")).applyInArrow(_proofs("__key"), f"__key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("__key", key)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(F.col(text), UPPER, LOWER)


def third(key: str) -> Column:
    """Rows whose crc32 (decimal key) is a multiple of 3; never those without a key."""
    return F.crc32(F.col(key).cast("string")) % 3 == 0
