"""Omnibus and paired tests over blocks of scores. Inputs are grids of systems times datasets, so pair tables are small."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import chi2_tail, normal_tail

from .ranks import average_rank

#: Two-sided Nemenyi quantiles for 2 to 20 systems.
NEMENYI = {
    0.05: (1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391, 3.426, 3.458, 3.489, 3.517, 3.544),
    0.10: (1.645, 2.052, 2.291, 2.460, 2.589, 2.693, 2.780, 2.855, 2.920, 2.978, 3.030, 3.077, 3.120, 3.159, 3.196, 3.230, 3.261, 3.291, 3.319),
}


def friedman(block: DataFrame) -> DataFrame:
    """One row: k, n, friedman_chi2 (corrected for ties), friedman_p, status; needs three systems and three datasets."""
    ranked = average_rank(block, ["dataset"])
    sums = ranked.groupBy("model").agg(F.sum("rank").alias("r")).agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    ties = ranked.groupBy("dataset", "rank").agg(F.count(F.lit(1)).alias("t")).agg(F.count_distinct("dataset").alias("n"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tt"))
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    c = 1 - F.col("tt") / (n * k * (k * k - 1))
    enough = (F.col("k") >= 3) & (F.col("n") >= 3)
    chi2 = F.when(enough & (c > 0), (12 / (n * k * (k + 1)) * F.col("rr") - 3 * n * (k + 1)) / c)
    out = sums.crossJoin(ties).withColumn("friedman_chi2", chi2)
    return out.select("k", "n", "friedman_chi2", chi2_tail(F.col("friedman_chi2"), F.col("k") - 1).alias("friedman_p"), F.when(enough, "ok").otherwise("insufficient_block").alias("status"))


def nemenyi_quantile(k: Column, alpha: float = 0.05) -> Column:
    if alpha not in NEMENYI:
        raise ValueError("alpha must be 0.05 or 0.10")
    return F.try_element_at(F.array(*map(F.lit, NEMENYI[alpha])), (k - 1).cast("int"))


def critical_difference(block: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: k, n, critical_difference; null beyond 20 systems."""
    size = block.agg(F.count_distinct("model").alias("k"), F.count_distinct("dataset").alias("n"))
    q = F.when(F.col("k").between(2, 20), nemenyi_quantile(F.col("k"), alpha))
    return size.select("k", "n", (q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))).alias("critical_difference"))


def cliques(ranks: DataFrame, cd: DataFrame) -> DataFrame:
    """Runs of systems, in order of mean rank, that lie within the critical difference of their first: from each first system not
    yet covered, as far as it reaches; runs of one are left out."""
    order = Window.orderBy("mean_rank", "model")
    placed = ranks.withColumn("i", F.row_number().over(order))
    cd = cd.select("critical_difference")
    reach = placed.alias("a").crossJoin(F.broadcast(cd)).join(placed.alias("b"), (F.col("b.i") >= F.col("a.i")) & (F.col("b.mean_rank") - F.col("a.mean_rank") <= F.col("critical_difference")))
    reach = reach.groupBy(F.col("a.i").alias("i")).agg(F.max("b.i").alias("j"))
    # the next start is the first system after the run: a fold over at most 20 rows
    rows = reach.agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("all"))
    none = F.array().cast("array<struct<i:int,j:int>>")
    kept = F.aggregate("all", F.struct(F.lit(0).alias("last"), none.alias("out")), lambda s, x: F.when(x.i > s.last, F.struct(F.when(x.j > x.i, x.j).otherwise(s.last).alias("last"), F.when(x.j > x.i, F.concat(s.out, F.array(x))).otherwise(s.out).alias("out"))).otherwise(s), lambda s: s.out)
    runs = rows.select(F.explode(kept).alias("r"))
    ends = placed.select("i", "model", "mean_rank")
    a, b = ends.select(F.col("i").alias("ai"), F.col("model").alias("from_model"), F.col("mean_rank").alias("from_rank")), ends.select(F.col("i").alias("bi"), F.col("model").alias("to_model"), F.col("mean_rank").alias("to_rank"))
    return runs.join(a, F.col("r.i") == F.col("ai")).join(b, F.col("r.j") == F.col("bi")).select("from_model", "to_model", "from_rank", "to_rank", (F.col("bi") - F.col("ai") + 1).alias("size"))


def pairs(grid: DataFrame) -> DataFrame:
    """(a, b, dataset, d): differences of every unordered pair of systems, a before b by name, on datasets that both have."""
    a, b = grid.select("dataset", F.col("model").alias("a"), F.col("score").alias("sa")), grid.select("dataset", F.col("model").alias("b"), F.col("score").alias("sb"))
    return a.join(b, "dataset").where("a < b").select("a", "b", "dataset", (F.col("sa") - F.col("sb")).alias("d"))


def wilcoxon(diffs: DataFrame, keys: list[str], keep_z: bool = False) -> DataFrame:
    """(keys, n, n_nonzero, w_plus, p_two, p_greater) of paired differences d; keep_z adds the normal form's z.

    Zeros are dropped. The null distribution is exact if nothing was dropped, no ranks tie and n is 50 at most; else normal, with tie correction and
    without continuity correction. No differences left: 1.
    """
    size = diffs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    ranked = average_rank(diffs.where("d <> 0").withColumn("__m", F.abs("d")), keys, "__m", "__r", ascending=True)
    tied = ranked.groupBy(*keys, "__m").agg(F.count(F.lit(1)).alias("__t"), F.sum(F.when(F.col("d") > 0, F.col("__r")).otherwise(0.0)).alias("__w"))
    stat = tied.groupBy(*keys).agg(F.sum("__t").alias("__k"), F.sum("__w").alias("w_plus"), F.sum(F.col("__t") * F.col("__t") * F.col("__t") - F.col("__t")).alias("__tt"), F.max("__t").alias("__most"))
    out = size.join(stat, keys, "left").withColumn("__k", F.coalesce("__k", F.lit(0)))
    k = F.col("__k").cast("int")
    start = F.transform(F.sequence(F.lit(0), (k * (k + 1) / 2).cast("int")), lambda i: F.when(i == 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    counts = F.aggregate(F.sequence(F.lit(1), k), start, lambda c, j: F.transform(c, lambda v, i: v + F.when(i >= j, F.get(c, i - j)).otherwise(0)))
    exact = (F.col("__k") == F.col("n")) & (F.col("__most") == 1) & (F.col("__k") <= 50)
    out = out.withColumn("__c", F.when(exact, counts))
    tail = lambda test: F.aggregate(F.filter("__c", test), F.lit(0).cast("bigint"), lambda a, v: a + v) / F.pow(F.lit(2.0), F.col("__k"))
    above, below = tail(lambda v, i: i >= F.col("w_plus")), tail(lambda v, i: i <= F.col("w_plus"))
    mean = F.col("__k") * (F.col("__k") + 1) / 4.0
    sd = F.sqrt((F.col("__k") * (F.col("__k") + 1) * (2 * F.col("__k") + 1) - F.col("__tt") / 2.0) / 24.0)
    out = out.withColumn("__z", (F.col("w_plus") - mean) / sd).withColumn("__a", F.abs("__z"))
    z = F.col("__z")
    far = normal_tail(F.col("__a"))
    one = F.when(z >= 0, far).otherwise(1 - far)
    p_greater = F.when(F.col("__k") == 0, 1.0).when(exact, above).otherwise(one)
    p_two = F.when(F.col("__k") == 0, 1.0).when(exact, F.least(F.lit(1.0), 2 * F.least(above, below))).otherwise(F.least(F.lit(1.0), 2 * far))
    return out.select(*keys, "n", F.col("__k").alias("n_nonzero"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), p_two.alias("p_two"), p_greater.alias("p_greater"), *([z.alias("z")] if keep_z else []))


def holm(rows: DataFrame, p: str, tie: list[str], out: str = "holm_p", by: list[str] | None = None) -> DataFrame:
    """rows with step-down adjusted p values over the whole family (or each of `by`); equal ones in order of `tie`."""
    part = Window.partitionBy(*(by or [])) if by else Window.partitionBy(F.lit(1))
    order = part.orderBy(p, *tie)
    m = F.count(F.lit(1)).over(part)
    scaled = rows.withColumn("__s", (m - F.row_number().over(order) + 1) * F.col(p))
    return scaled.withColumn(out, F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def pairwise(block: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(a, b, wilcoxon_p, holm_p, rank_gap, separated_by_cd, significant_holm) of all pairs of a block's systems."""
    ranks = average_rank(block, ["dataset"]).groupBy("model").agg(F.avg("rank").alias("mean_rank"))
    tests = holm(wilcoxon(pairs(block), ["a", "b"]), "p_two", ["a", "b"])
    both = tests.join(ranks.select(F.col("model").alias("a"), F.col("mean_rank").alias("ra")), "a").join(ranks.select(F.col("model").alias("b"), F.col("mean_rank").alias("rb")), "b").crossJoin(F.broadcast(critical_difference(block, alpha).select("critical_difference")))
    gap = F.abs(F.col("ra") - F.col("rb"))
    return both.select("a", "b", F.col("p_two").alias("wilcoxon_p"), "holm_p", gap.alias("rank_gap"), (gap > F.col("critical_difference")).alias("separated_by_cd"), (F.col("holm_p") < alpha).alias("significant_holm"))


def claims_of(block: DataFrame) -> DataFrame:
    """(id, a, b): systems in order of mean score, each earlier one claimed to beat each later one."""
    means = block.groupBy("model").agg(F.avg("score").alias("s")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), "model")))
    a, b = means.select(F.col("model").alias("a"), F.col("r").alias("ra")), means.select(F.col("model").alias("b"), F.col("r").alias("rb"))
    return a.join(b, F.col("ra") < F.col("rb")).select(F.concat("a", F.lit("_beats_"), "b").alias("id"), "a", "b")


def survival(claims: DataFrame, grid: DataFrame, block: DataFrame, intervals, alpha: float = 0.05, least: int = 3) -> DataFrame:
    """Claims that a beats b: paired on the block, or on the grid where a system isn't in the block (outside_complete_block).

    One-sided test, interval of the mean difference (intervals: what resample.mean_interval is), adjustment over all claims; those with fewer than `least` shared
    datasets have p = 1, count in the family and have no verdict.
    """
    inside = block.select("model").distinct().withColumn("inside", F.lit(True))
    c = claims.join(inside.withColumnsRenamed({"model": "a", "inside": "ia"}), "a", "left").join(inside.withColumnsRenamed({"model": "b", "inside": "ib"}), "b", "left")
    c = c.select("id", "a", "b", F.coalesce("ia", F.lit(False)).alias("ia"), F.coalesce("ib", F.lit(False)).alias("ib"))
    own = block.select("model", "dataset", "score", F.lit(True).alias("of_block")).unionByName(grid.join(block.select("model").distinct(), "model", "left_anti").select("model", "dataset", "score", F.lit(False).alias("of_block")))
    a, b = (own.select(F.col("model").alias(x), "dataset", F.col("score").alias(f"s{x}")) for x in "ab")
    d = c.join(a, "a").join(b, ["b", "dataset"]).select("id", "dataset", (F.col("sa") - F.col("sb")).alias("d"))
    tests = wilcoxon(d, ["id"]).join(intervals(d, ["id"], "d"), "id")
    out = c.join(tests, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= least
    out = out.withColumn("p", F.when(enough, F.col("p_greater")).otherwise(1.0))
    out = holm(out, "p", ["id"])
    return out.select(
        "id", "a", "b", F.col("n").alias("n_datasets"), F.when(enough, F.col("mean")).alias("mean_delta"), F.col("p").alias("wilcoxon_p_onesided"), F.when(enough, F.col("lo")).alias("ci_lo"), F.when(enough, F.col("hi")).alias("ci_hi"),
        (~(F.col("ia") & F.col("ib"))).alias("outside_complete_block"), "holm_p", F.when(enough, (F.col("holm_p") < alpha) & (F.col("lo") > 0)).alias("survives"),
    )


def kendall(rows: DataFrame, keys: list[str], x: str, y: str, item: str = "model") -> DataFrame:
    """(keys, n_items, tau, tau_p): tau-b of x and y over items; exact p for up to 33 items without ties, else normal."""
    a, b = (rows.select(*keys, F.col(item).alias(f"i{s}"), F.round(x, 9).alias(f"x{s}"), F.round(y, 9).alias(f"y{s}")) for s in "ab")
    join = a.join(b, keys) if keys else a.crossJoin(b)
    sx, sy = F.signum(F.col("xa") - F.col("xb")), F.signum(F.col("ya") - F.col("yb"))
    p = join.where("ia < ib").select(*keys, "ia", "ib", sx.alias("sx"), sy.alias("sy"))
    stat = p.groupBy(*keys).agg(F.sum(F.col("sx") * F.col("sy")).alias("s"), F.sum(F.col("sx") * F.col("sx")).alias("xx"), F.sum(F.col("sy") * F.col("sy")).alias("yy"), F.count(F.lit(1)).alias("m"))
    stat = stat.withColumn("n_items", F.round((1 + F.sqrt(1 + 8.0 * F.col("m"))) / 2).cast("int"))
    tau = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("s") / F.sqrt(F.col("xx") * F.col("yy")))
    n = F.col("n_items")
    free = (F.col("xx") == F.col("m")) & (F.col("yy") == F.col("m")) & (n <= 33)
    # permutations of n items by inversions, as shares: each item adds 0 to j - 1 of them
    top = (n * (n - 1) / 2).cast("int")
    start = F.transform(F.sequence(F.lit(0), top), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    shares = F.aggregate(F.sequence(F.lit(2), n), start, lambda c, j: F.transform(c, lambda v, i: F.aggregate(F.slice(c, F.greatest(i - j + 1, F.lit(0)) + 1, F.least(j, i + 1)), F.lit(0.0), lambda s, u: s + u) / j))
    least = F.least((F.col("m") - F.col("s")) / 2, (F.col("m") + F.col("s")) / 2)
    exact = F.least(F.lit(1.0), 2 * F.aggregate(F.filter(shares, lambda v, i: i <= least), F.lit(0.0), lambda s, u: s + u))
    stat = stat.withColumn("__z", F.abs(F.col("s")) / F.sqrt(n * (n - 1) * (2 * n + 5) / 18.0))
    z = F.col("__z")
    return stat.select(*keys, "n_items", tau.alias("tau"), F.when(tau.isNull(), None).when(free, exact).otherwise(F.least(F.lit(1.0), 2 * normal_tail(z))).alias("tau_p"))
