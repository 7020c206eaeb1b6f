"""Running sums over ranges, and exact quantiles by refining histograms: windows and sorts without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.session import stored


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """rows with, for each of sums (name: column over rows), the sum over the rows of the same keys up to and with this one in `order`, and under name_all over all of them.

    Rows are cut into ranges of (keys, order), whatever the sizes of groups; each range has its own running sums, and a group's totals of the ranges before are added. So a group
    with most rows is spread over as many tasks as the others. Rows that tie in order stay in one range and have sums of their own, in any order. The table of ranges has a row for each range and each key in it.
    """
    spark = rows.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = [*keys, *order]
    own = rows.withColumns({f"__{k}": v for k, v in sums.items()})
    own = stored(own.repartitionByRange(parts, *at).sortWithinPartitions(*at).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = own.groupBy("__range", *keys).agg(*[F.sum(f"__{k}").alias(f"__t_{k}") for k in sums])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    told = {f"__b_{k}": F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)) for k in sums} | {f"__a_{k}": F.sum(f"__t_{k}").over(group) for k in sums}
    totals = totals.withColumns(told).select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k_{k}") for k in keys], *told)
    same = F.col("__range") == F.col("__r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = own.withColumns({f"__l_{k}": F.sum(f"__{k}").over(inside) for k in sums}).join(totals, same)
    return out.select(*rows.columns, *[c for k in sums for c in ((F.col(f"__l_{k}") + F.col(f"__b_{k}")).alias(k), F.col(f"__a_{k}").alias(f"{k}_all"))])


def quantiles(rows: DataFrame, column: str, shares: list[float], bins: int = 4096, few: int = 100_000) -> list[float] | None:
    """Exact quantiles with interpolation, as percentile() gives, of a column's known values; None without any.

    Values are counted in equal buckets between the least and the largest; only buckets that hold a wanted place are counted again, in finer buckets, until they hold `few` rows
    in all or one value each. Then their values are counted one by one. What comes to the driver are the counts of a pass' buckets, and at last those values. Each pass
    reads the column; of n rows there are about log(n / few) / log(bins) passes, and as many more as values lie unevenly.
    """
    x = rows.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n, low, high = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    places = [s * (n - 1) for s in shares]
    wanted = sorted({int(p) for p in places} | {min(n - 1, int(p) + 1) for p in places})
    # open stretches: (from, to, rows before, rows, places inside), both ends within
    stretches, sure = [(low, high, 0, n, wanted)], {}
    while True:
        left = []
        for a, b, before, count, inside in stretches:
            if a == b:
                sure |= dict.fromkeys(inside, a)
            else:
                left.append((a, b, before, count, inside))
        stretches = left
        if not stretches or sum(s[3] for s in stretches) <= few:
            break
        width = lambda a, b: (b - a) / bins
        own = F.array(*[F.when((F.col("x") >= a) & (F.col("x") <= b), F.struct(F.lit(k).alias("k"), F.least(F.floor((F.col("x") - a) / width(a, b)), F.lit(bins - 1)).alias("b"), "x")) for k, (a, b, *_) in enumerate(stretches)])
        told = x.select(F.explode(F.filter(own, lambda s: s.isNotNull())).alias("s")).groupBy("s.k", "s.b").agg(F.count(F.lit(1)).alias("n"), F.min("s.x").alias("low"), F.max("s.x").alias("high")).orderBy("k", "b").collect()
        new = []
        for k, (_, _, before, _, inside) in enumerate(stretches):
            at = before
            for r in (r for r in told if r["k"] == k):
                held = [p for p in inside if at <= p < at + r["n"]]
                if held:
                    new.append((r["low"], r["high"], at, r["n"], held))
                at += r["n"]
        stretches = new
    if stretches:
        hit = [(F.col("x") >= a) & (F.col("x") <= b) for a, b, *_ in stretches]
        some = hit[0]
        for h in hit[1:]:
            some = some | h
        values = sorted(tuple(r) for r in x.where(some).groupBy("x").agg(F.count(F.lit(1))).collect())
        for a, b, before, _, inside in stretches:
            at = before
            for v, c in values:
                if a <= v <= b:
                    sure |= {p: v for p in inside if at <= p < at + c}
                    at += c
    out = []
    for p in places:
        k = int(p)
        a, b = sure[k], sure[min(n - 1, k + 1)]
        out.append(a if a == b else (k + 1 - p) * a + (p - k) * b)
    return out
