"""Splits, folds and samples in the order of md5(seed:row): deterministic, and the same wherever rows lie."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import quantiles


def key(seed: int | str | Column, row: str) -> Column:
    return F.md5(F.concat_ws(":", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), F.col(row).cast("string")))


def strata(rows: DataFrame, y: str, bins: int = 10, out: str = "stratum") -> DataFrame:
    """rows with quantile bins of y (right-closed, the lowest edge included, equal edges once); as many as there are distinct values at most. Edges are exact, by refined histograms."""
    few = rows.select(y).where(F.col(y).isNotNull()).distinct().limit(bins).count()
    q = max(1, min(bins, few))
    edges = sorted(set(quantiles(rows, y, [k / q for k in range(q + 1)]) or []))
    at = F.array(*[F.lit(e) for e in edges]).cast("array<double>")
    return rows.withColumn(out, F.greatest(F.size(F.filter(at, lambda x: x < F.col(y))) - 1, F.lit(0)))


def places(rows: DataFrame, by: str, row: str, seed: int | str, at: str = "__at", n: str = "__n") -> DataFrame:
    """rows with the place of each, from 1, in its group's md5 order, and the group's size.

    Counts of the first 16 bits tell how many rows come before each bucket; only a bucket's rows are sorted together, so that a group may hold any share of the rows.
    """
    r = rows.withColumn("__k", key(seed, row)).withColumn("__b", F.conv(F.substring("__k", 1, 4), 16, 10).cast("int"))
    sizes = r.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(by)
    sizes = sizes.select(F.col(by).alias("__by"), F.col("__b").alias("__bb"), (F.sum("__c").over(group.orderBy("__b")) - F.col("__c")).alias("__before"), F.sum("__c").over(group).alias(n))
    r = r.join(sizes, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__bb")))
    return r.withColumn(at, F.col("__before") + F.row_number().over(Window.partitionBy(by, "__b").orderBy("__k", row))).drop("__k", "__b", "__by", "__bb", "__before")


def cuts(rows: DataFrame, by: list[str], row: str, seed: int | str | Column, ends: Callable[[Column], list[Column]], out: str = "__part") -> DataFrame:
    """rows with how many of the places that ends(rows in the group) gives lie before a row's, in its group's md5 order.

    Counts by group and leading bits tell the bucket that holds each end; only these buckets' rows are ranked, and give each group's ends as keys, so that
    a row's part is a comparison: rows aren't shuffled, and groups may hold any share of them. Groups are few beside rows.
    """
    own = rows.select(*by, F.col(row).alias("__row"), key(seed, row).alias("__k")).withColumn("__b", F.conv(F.substring("__k", 1, 3), 16, 10).cast("int"))
    group = Window.partitionBy(*by)
    sizes = own.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__c"))
    sizes = sizes.withColumns({"__to": F.sum("__c").over(group.orderBy("__b")), "__n": F.sum("__c").over(group)})
    wanted = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), e.cast("long").alias("end")) for j, e in enumerate(ends(F.col("__n")))]))
    hit = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__b").alias("__bb"), "__c", "__to", wanted.alias("__e")).where("__e.end <= __to and __e.end > __to - __c")
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    near = own.join(hit, reduce(and_, same, F.col("__b") == F.col("__bb")))
    place = F.row_number().over(Window.partitionBy(*by, "__e.j").orderBy("__k", "__row")) + F.col("__to") - F.col("__c")
    at = near.withColumn("__place", place).where("__place = __e.end").groupBy(*[F.col(c).alias(f"__by_{c}") for c in by])
    count = len(ends(F.lit(0)))
    at = at.agg(*[F.max(F.when(F.col("__e.j") == j, F.struct("__k", "__row"))).alias(f"__end{j}") for j in range(count)])
    # a group without an end that is 0 or less has no key for it
    this = F.struct(F.col("__k"), F.col(row).alias("__row"))
    part = sum((F.coalesce((this > F.col(f"__end{j}")).cast("int"), F.lit(1)) for j in range(count)), F.lit(0))
    told = rows.withColumn("__k", key(seed, row)).join(at, reduce(and_, same), "left").withColumn(out, part)
    return told.drop("__k", *[f"__by_{c}" for c in by], *[f"__end{j}" for j in range(count)])


def holdout(rows: DataFrame, y: str, row: str, seed: int, train: float = 0.64, val: float = 0.16, continuous: bool = False) -> DataFrame:
    """rows with fold, cut twice: a share of each stratum is train; the remainder's strata, derived anew, are cut into val and test.

    Strata are the values of y or, if it is continuous, its quantile bins. Rows come in md5 order. The remainder of a value is the rest of its order, so that values need one pass for both cuts.
    """
    rest = val / (1 - train)
    name = lambda part, *names: F.element_at(F.array(*map(F.lit, names)), part + 1)
    if not continuous:
        first = lambda n: F.round(n * train)
        told = cuts(rows.withColumn("__s", F.col(y)), ["__s"], row, seed, lambda n: [first(n), first(n) + F.round((n - first(n)) * rest)])
        return told.withColumn("fold", name(F.col("__part"), "train", "val", "test")).drop("__s", "__part")
    told = cuts(strata(rows, y, out="__s"), ["__s"], row, seed, lambda n: [F.round(n * train)]).withColumnRenamed("__part", "__late").drop("__s")
    left = told.where("__late = 1").drop("__late")
    late = cuts(strata(left, y, out="__s"), ["__s"], row, seed, lambda n: [F.round(n * rest)]).withColumn("fold", name(F.col("__part"), "val", "test"))
    return told.where("__late = 0").drop("__late").withColumn("fold", F.lit("train")).unionByName(late.drop("__s", "__part"))


def folds(rows: DataFrame, stratum: str, row: str, seed: int, k: int = 5) -> DataFrame:
    return places(rows, stratum, row, seed).withColumn("inner_fold", F.pmod(F.col("__at") - 1, F.lit(k)).cast("int")).drop("__at", "__n")


def carve(rows: DataFrame, stratum: str, row: str, seed: int, share: float = 0.15) -> DataFrame:
    """rows with early_stop: a share of each stratum; where any stratum has fewer than two rows, of all rows alike."""
    small = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")).agg((F.min("n") < 2).alias("plain"))
    r = rows.crossJoin(F.broadcast(small)).withColumn("__s", F.when(~F.col("plain"), F.col(stratum).cast("string")).otherwise("all"))
    return cuts(r, ["__s"], row, seed, lambda n: [F.round(n * share)]).withColumn("early_stop", F.col("__part") == 0).drop("__s", "plain", "__part")


def honoured(rows: DataFrame, made: DataFrame, row: str, shipped: str = "fold") -> DataFrame:
    """rows with fold: the shipped one where there is any for all rows, else that of `made` (row, fold)."""
    whole = F.broadcast(rows.agg((F.count(shipped) == F.count(F.lit(1))).alias("__whole")))  # one row
    own = rows.withColumnRenamed(shipped, "__shipped").join(made.select(row, F.col("fold").alias("__made")), row).crossJoin(whole)
    return own.withColumn("fold", F.when(F.col("__whole"), F.col("__shipped")).otherwise(F.col("__made"))).drop("__shipped", "__made", "__whole")


def temporal(rows: DataFrame, when: str, train: float = 0.64, val: float = 0.16) -> DataFrame:
    """rows with fold by the time's quantiles, exact by refined histograms; the seed doesn't move it. A row without a time is in test."""
    seconds = F.unix_timestamp(F.col(when).cast("timestamp"))
    first, last = quantiles(rows.select(seconds.alias("t")), "t", [train, train + val]) or (0.0, 0.0)
    return rows.withColumn("fold", F.when(seconds <= first, "train").when(seconds <= last, "val").otherwise("test"))


def subsample(rows: DataFrame, row: str, n: int, seed: int) -> DataFrame:
    """Exactly n rows (or all), without replacement."""
    return rows.orderBy(key(seed, row), row).limit(n)


def size_strata(items: DataFrame, task: str, n: str, out: str = "stratum") -> DataFrame:
    """items with task:size, small, medium or large by the task's terciles (elements n div 3 and 2n div 3 in order; of fewer than three, least and most)."""
    s = items.groupBy(task).agg(F.array_sort(F.collect_list(n)).alias("__s"))
    c = F.size("__s")
    low = F.when(c < 3, F.element_at("__s", 1)).otherwise(F.element_at("__s", (F.floor(c / 3) + 1).cast("int")))
    high = F.when(c < 3, F.element_at("__s", -1)).otherwise(F.element_at("__s", (F.floor(2 * c / 3) + 1).cast("int")))
    r = items.join(s.select(task, low.alias("__a"), high.alias("__b")), task)
    return r.withColumn(out, F.concat(task, F.lit(":"), F.when(F.col(n) <= F.col("__a"), "small").when(F.col(n) <= F.col("__b"), "medium").otherwise("large"))).drop("__a", "__b")


def quota(items: DataFrame, stratum: str, k: int) -> DataFrame:
    """(stratum, n, quota): largest remainders of k seats, ties by name."""
    g = items.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    all_ = Window.partitionBy(F.lit(1))
    share = g.withColumn("__x", F.col("n") * F.lit(float(k)) / F.sum("n").over(all_))
    rest = F.round(F.col("__x") - F.floor("__x"), 9)
    r = share.withColumn("__f", F.floor("__x")).withColumn("__o", F.row_number().over(all_.orderBy(F.desc(rest), stratum))).withColumn("__left", F.lit(k) - F.sum("__f").over(all_))
    return r.select(stratum, "n", (F.col("__f") + F.when(F.col("__o") <= F.col("__left"), 1).otherwise(0)).cast("int").alias("quota"))


def draw(items: DataFrame, stratum: str, name: str, k: int, seed: int) -> DataFrame:
    """items drawn to each stratum's quota in md5 order, topped up in the same order where a stratum is short."""
    q = quota(items, stratum, k).select(stratum, "quota")
    r = items.join(q, stratum).withColumn("__at", F.row_number().over(Window.partitionBy(stratum).orderBy(key(seed, name), name)))
    first = r.withColumn("__late", F.col("__at") > F.col("quota"))
    order = Window.partitionBy(F.lit(1)).orderBy("__late", key(seed, name), name)
    return first.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).drop("quota", "__at", "__late", "__place")
