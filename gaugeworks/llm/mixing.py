"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions alone.

A source's target is its share of all words by weight, at most `most` times its words; what is above goes to the others by weight until none is above.
The mix is made of blocks of equal numbers of words. Seats (blocks) go to sources by the highest quotients weight / (2k - 1), and a source's seats
to its shards in the same way, by the shards' words: whole numbers, which add up. Within a shard documents stand in an order drawn from
the seed, end to end; the shard's quota of its blocks is spread evenly over them, beginning at a drawn phase, so that no block is taken more than
`most` times, and a document has the words of it that lie in blocks taken.

Highest quotients without a loop: with n parties, scaling shares by (seats - n/2) / seats and rounding gives too few seats in all, by (seats + n/2) / seats too
many. Only the quotients between, 4n at most, are ranked. Blocks are never rows: a document's words come from the counts at its two ends.

The block is the largest that leaves every source with words 1 / `precision` blocks in its target, and `block` words at most; the work doesn't depend on it.
Sources hold any share of the rows: shards have about `shard_words` words or `shard_rows` rows, whatever their source. Equal rows (a null id, say) are counted before they are
shuffled, and dealt to shards in runs of `run` copies.

Defined results: null and empty texts have size 0 and nothing taken; a null source is a source, the last one; rows that share an id are documents of their own;
equal rows have the same results in any order. An empty table gives an empty result. Texts are read once, into a table of sizes. One row a source, and four
quotients a source, or for one source four quotients a shard, are ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"


def _all() -> WindowSpec:
    return Window.partitionBy()


def sizes(docs: DataFrame, run: int = 4096, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(source, key, size, run, copies): equal rows counted, in runs of `run` copies at most."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(source).alias("source"), F.col(key).alias("key"), size.alias("size")).groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("n"))
    runs = rows.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {run}"))))
    return runs.select("source", "key", "size", "run", F.least(F.lit(run), F.col("n") - F.col("run") * run).alias("copies"))


def weighed(totals: DataFrame, weights: Sequence[float] | DataFrame) -> DataFrame:
    """totals with a weight: a table (source, weight), 0 where it has none, or numbers that repeat over the sources in order of code points, null last."""
    if isinstance(weights, DataFrame):
        known = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        return totals.join(known, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s").fillna(0.0, ["weight"])
    place = F.row_number().over(_all().orderBy(F.col("source").asc_nulls_last()))
    return totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place - 1) % len(weights) + 1))


def targets(totals: DataFrame, most: int = 3) -> DataFrame:
    """(source, words, weight, ...) with target: shares of all words by weight, none above most * words; a weight of 0 has none.

    In order of limit / weight the limited sources come first, and whether one is limited follows from the sums over those before it.
    """
    limit = F.col("words") * most
    ratio = F.try_divide(limit.cast("double"), F.col("weight"))
    before = _all().orderBy(ratio.asc_nulls_last(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = totals.withColumns({"all": F.sum("words").over(_all()), "w": F.sum("weight").over(_all()), "limit": limit, "c": F.coalesce(F.sum(limit).over(before), F.lit(0)), "v": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    out = out.withColumn("full", (F.col("weight") > 0) & (F.col("limit") * (F.col("w") - F.col("v")) <= F.col("weight") * (F.col("all") - F.col("c"))))
    kept = lambda x: F.sum(F.when(F.col("full"), F.col(x)).otherwise(F.lit(0))).over(_all())
    out = out.withColumn("rate", F.coalesce(F.try_divide((F.col("all") - kept("limit")).cast("double"), F.col("w") - kept("weight")), F.lit(0.0)))
    return out.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("weight") * F.col("rate")))).drop("w", "limit", "c", "v", "full", "rate")


def apportion(parties: DataFrame, by: list[str], weight: str, seats: str, order: list[str], into: str = "quota") -> DataFrame:
    """parties with their share of `seats` (the same within each `by`) by Sainte-Lague: highest quotients of weight, ties in order of `order`."""
    own = Window.partitionBy(*by)
    total, n = F.sum(F.col(weight).cast("double")).over(own), F.count(F.lit(1)).over(own)
    share, slack = F.coalesce(F.try_divide(F.col(weight) * F.col(seats).cast("double"), total), F.lit(0.0)), F.coalesce(F.try_divide(F.col(weight) * n, total * 2), F.lit(0.0))
    out = parties.withColumns({"__low": F.greatest(F.lit(0).cast("bigint"), F.floor(share - slack + 0.5) - 1), "__high": F.floor(share + slack + 0.5) + 1})
    out = out.withColumn("__open", F.col(seats) - F.sum("__low").over(own)).withColumn("__k", F.explode(F.sequence(F.col("__low") + 1, F.col("__high"))))
    quotient = F.col(weight) / (F.col("__k") * 2 - 1)
    place = F.row_number().over(own.orderBy(quotient.desc(), *[F.col(c).asc_nulls_last() for c in order], "__k"))
    won = ((F.col("__place") <= F.col("__open")) & (F.col(weight) > 0)).cast("bigint")
    return out.withColumn("__place", place).groupBy(*parties.columns).agg((F.first("__low") + F.sum(won)).alias(into))


def _words_before(x: Column) -> Column:
    """Words that the blocks taken have before word x of a shard."""
    seats = lambda b: F.call_function("div", b * F.col("quota") + F.col("phase"), F.col("blocks"))
    b = F.call_function("div", x, F.col("block"))
    return seats(b) * F.col("block") + (x - b * F.col("block")) * (seats(b + 1) - seats(b))


def mix(
    docs: DataFrame, weights: Sequence[float] | DataFrame = (1, 2, 3), most: int = 3, seed: str = "mix", block: int = 1024, precision: float = 0.001,
    shard_words: int = 1 << 20, shard_rows: int = 1 << 12, run: int = 4096, key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """A row for each of docs: key, source, size, source_size, target, taken, and the shard, its words and its quota of blocks."""
    rows, _ = common.stored(sizes(docs, run, key, source, text), "sizes")
    totals = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.count(F.lit(1)).alias("rows"))
    plan = targets(weighed(totals, weights), most)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(_all())
    plan = plan.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least * precision))), F.lit(1)).cast("bigint"))
    plan = plan.withColumn("seats", F.round(F.sum("target").over(_all()) / F.col("block")).cast("bigint"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("words") / shard_words), F.ceil(F.col("rows") / shard_rows))
    plan = apportion(plan.withColumn("shards", shards), [], "target", "seats", ["source"], "own")
    plan, used = common.stored(plan.select(F.col("source").alias("__s"), "words", "target", "block", "own", "shards"), "mix-plan")
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("__s"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "key", "size", "run"), F.col("shards")))
    parts = dealt.groupBy("source", "shard", "block", "own").agg(F.sum(F.col("size") * F.col("copies")).alias("held"))
    quotas = apportion(parts, ["source"], "held", "own", ["shard"])
    quotas = quotas.withColumn("blocks", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("held") / F.col("block"))))
    quotas = quotas.withColumns({"quota": F.least("quota", F.col("blocks") * most), "phase": F.pmod(F.xxhash64(F.lit(seed), F.lit("phase"), "source", "shard"), F.col("blocks"))})
    quotas, _ = common.stored(quotas.select(F.col("source").alias("__q"), F.col("shard").alias("__n"), "held", "quota", "blocks", "phase"), "mix-quotas")
    both = dealt.join(quotas, F.col("source").eqNullSafe(F.col("__q")) & (F.col("shard") == F.col("__n")))
    drawn = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), F.lit("order"), "key", "size", "run"), "key", "size", "run")
    end = F.sum(F.col("size") * F.col("copies")).over(drawn.rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("at", end - F.col("size") * F.col("copies")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    placed = placed.withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    taken = _words_before(F.col("at") + F.col("size")) - _words_before(F.col("at"))
    return placed.select(F.col("key").alias(key), "source", "size", F.col("words").alias("source_size"), "target", taken.alias("taken"), "shard", F.col("held").alias("shard_size"), F.col("quota").alias("shard_blocks"), "block")
