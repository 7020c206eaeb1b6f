"""Metrics of cells from long prediction tables. All are aggregates of the cell's keys; equal scores are
counted together before the shuffle, so that ranks need no window over rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import EPS, bin_of, normal_cdf

from . import prefix


def _swept(tied: DataFrame, keys: list[str], spread: bool = False) -> DataFrame:
    """tied (keys, s, pos, n) with below, the negatives of lower scores, and tp and seen, the positives and rows of this score or higher: one sort for all.

    spread: by ranges of scores, so that a cell of many distinct scores is not one task's; it takes a pass more.
    """
    pos, n = F.col("pos"), F.col("n")
    if spread:
        t = prefix.running(tied, keys, ["s"], {"__p": pos, "__n": n}).withColumnsRenamed({"__p_all": "__ap", "__n_all": "__an"})
    else:
        part = Window.partitionBy(*keys)
        up = part.orderBy("s")
        t = tied.withColumn("__p", F.sum(pos).over(up)).withColumn("__n", F.sum(n).over(up)).withColumn("__ap", F.sum(pos).over(part)).withColumn("__an", F.sum(n).over(part))
    return t.withColumn("below", F.col("__n") - n - (F.col("__p") - pos)).withColumn("tp", F.col("__ap") - F.col("__p") + pos).withColumn("seen", F.col("__an") - F.col("__n") + n)


def _tied(p: DataFrame, keys: list[str], y: str = "y", score: str = "score") -> DataFrame:
    return p.groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.count(F.lit(1)).alias("n"))


def _areas() -> list[Column]:
    """auc and pr_auc over swept rows."""
    pos, all_, neg = F.sum("pos"), F.sum("n"), F.col("n") - F.col("pos")
    return [
        F.when((pos > 0) & (pos < all_), F.sum(F.col("pos") * (F.col("below") + neg / 2)) / (pos * (all_ - pos))).alias("auc"),
        F.when(pos > 0, F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / pos).alias("pr_auc"),
    ]


def ranking(p: DataFrame, keys: list[str], y: str = "y", score: str = "score", spread: bool = False) -> DataFrame:
    """(keys, auc, pr_auc): area under the ROC curve with ties, null for one class; average precision over distinct scores, null without positives."""
    return _swept(_tied(p, keys, y, score), keys, spread).groupBy(*keys).agg(*_areas())


def calibration_error(p: DataFrame, keys: list[str], conf: Column, right: Column, bins: int = 15) -> DataFrame:
    """(keys, ece): over bins, the share of all rows times the distance of accuracy and mean confidence."""
    b = p.select(*keys, conf.alias("c"), right.cast("double").alias("r")).withColumn("b", bin_of(F.col("c"), bins))  # c is computed once
    per = b.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    return per.groupBy(*keys).agg((F.sum(F.when(F.col("b").isNotNull(), F.abs(F.col("r") - F.col("c"))).otherwise(0.0)) / F.sum("n")).alias("ece"))


def binary(p: DataFrame, keys: list[str], bins: int = 15, spread: bool = False) -> DataFrame:
    """(keys, n, auc, acc, log_loss, brier, pr_auc, ece) of binary predictions (y, score: probability of 1).

    All of them are sums over the counts of equal scores: the predictions are read once. spread: for cells that may hold most predictions, with as many scores; the same figures.
    """
    s, pos, n = F.col("s"), F.col("pos"), F.col("n")
    t = _swept(_tied(p, keys), keys, spread).withColumn("right", F.when(s > 0.5, pos).otherwise(n - pos)).withColumn("conf", F.greatest(s, 1 - s))
    t = t.withColumn("bin", bin_of(F.col("conf"), bins)).withColumn("off", F.col("right") - n * F.col("conf"))
    log = lambda q: -F.log(F.greatest(F.least(q, F.lit(1 - EPS)), F.lit(EPS)))
    error = sum((F.abs(F.coalesce(F.sum(F.when(F.col("bin") == k, F.col("off"))), F.lit(0.0))) for k in range(bins)), F.lit(0.0))
    return t.groupBy(*keys).agg(
        F.sum("n").alias("n"), *_areas(), (F.sum("right") / F.sum("n")).alias("acc"), (F.sum(pos * log(s) + (n - pos) * log(1 - s)) / F.sum("n")).alias("log_loss"),
        (F.sum(2 * (pos * (1 - s) * (1 - s) + (n - pos) * s * s)) / F.sum("n")).alias("brier"), (error / F.sum("n")).alias("ece"),
    ).select(*keys, "n", "auc", "acc", "log_loss", "brier", "pr_auc", "ece")


def softmax(raw: Column, classes: int) -> Column:
    e = F.transform(F.slice(raw, 1, classes), lambda x: F.exp(x.cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, v: a + v))


def _many(classes: int | str) -> Column:
    """A number of classes, or the column that has it."""
    return F.col(classes) if isinstance(classes, str) else F.lit(classes)


def padded(proba: Column, ids: Column | None, classes: int | str) -> Column:
    """Probabilities for all classes; those without a column get 0. ids: the classes that columns stand for; without, or where they are as many as no columns, columns are the first classes."""
    plain = F.transform(F.sequence(F.lit(0), _many(classes).cast("int") - 1), lambda k: F.coalesce(F.get(proba, k), F.lit(0.0)))
    if ids is None:
        return plain
    own = F.map_from_arrays(ids, proba)
    named = F.transform(F.sequence(F.lit(0), _many(classes).cast("int") - 1), lambda k: F.coalesce(F.try_element_at(own, k), F.lit(0.0)))
    return F.when(F.size(ids) == F.size(proba), named).otherwise(plain)


def sum_deviation(proba: Column) -> Column:
    """How far a row's probabilities are from a sum of 1."""
    return F.abs(F.aggregate(proba, F.lit(0.0), lambda a, v: a + v) - 1)


def divided(proba: Column) -> Column:
    """Probabilities over their sum; a sum of 0 counts as 1."""
    total = F.aggregate(proba, F.lit(0.0), lambda a, v: a + v)
    return F.transform(proba, lambda v: v / F.when(total == 0, 1.0).otherwise(total))


def renormalised(proba: Column) -> dict[str, Column]:
    """Rows whose sum is off by more than 1e-9 are divided by it (a zero sum by 1); with the deviation. Row by row: a record's own decision, by its largest deviation, is cells.record's."""
    total = F.aggregate(proba, F.lit(0.0), lambda a, v: a + v)
    off = F.abs(total - 1)
    return {"proba": F.when(off > 1e-9, F.transform(proba, lambda v: v / F.when(total == 0, 1.0).otherwise(total))).otherwise(proba), "proba_max_sum_deviation": off, "proba_renormalised": off > 1e-9}


def multiclass(p: DataFrame, keys: list[str], classes: int | str) -> DataFrame:
    """(keys, n, auc, acc, log_loss, brier, pr_auc, ece) of predictions (y, proba); classes: how many, or the column that has a cell's number. AUC is the mean over pairs of classes, both
    ways, each among the rows of the two; null unless every class occurs. Average precision is the mean over classes, 0 for one that doesn't occur."""
    p = p.select(*keys, "y", "proba", _many(classes).cast("int").alias("__classes"))
    y, q = F.col("y"), F.col("proba")
    top = F.array_max(q)
    right = F.array_position(q, top) - 1 == y
    own = F.element_at(q, y.cast("int") + 1)
    plain = p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("seen"), F.max("__classes").alias("__of"), F.avg(right.cast("double")).alias("acc"), F.avg(-F.log(F.greatest(F.least(own, F.lit(1 - EPS)), F.lit(EPS)))).alias("log_loss"),
        F.avg(F.aggregate(F.transform(q, lambda v, k: (v - F.when(k == y, 1.0).otherwise(0.0)) * (v - F.when(k == y, 1.0).otherwise(0.0))), F.lit(0.0), lambda a, v: a + v)).alias("brier"),
    )
    others = p.select(*keys, "y", "proba", F.explode(F.sequence(F.lit(0), F.col("__classes") - 1)).alias("d")).where("d <> y")
    sides = others.select(*keys, F.least("y", "d").alias("i"), F.greatest("y", "d").alias("j"), F.explode(F.array("y", "d")).alias("side"), "y", "proba")
    pairs = ranking(sides.select(*keys, "i", "j", "side", (F.col("side") == F.col("y")).cast("int").alias("y"), F.element_at("proba", F.col("side").cast("int") + 1).alias("score")), [*keys, "i", "j", "side"])
    auc = pairs.groupBy(*keys).agg(F.avg("auc").alias("auc"))
    rest = p.select(*keys, F.posexplode("proba").alias("k", "score"), "y").select(*keys, "k", (F.col("k") == F.col("y")).cast("int").alias("y"), "score")
    ap = ranking(rest, [*keys, "k"]).groupBy(*keys).agg(F.avg(F.coalesce("pr_auc", F.lit(0.0))).alias("pr_auc"))
    out = plain.join(auc, keys, "left").join(ap, keys).join(calibration_error(p, keys, top, right), keys)
    return out.withColumn("auc", F.when(F.col("seen") == F.col("__of"), F.col("auc"))).select(*keys, "n", "auc", "acc", "log_loss", "brier", "pr_auc", "ece")


def crps(z: Column, sigma: Column, scaled: Column | None = None) -> Column:
    """Continuous ranked probability score of a normal forecast in units of z = (y - mu) / sigma, sigma at least 1e-9; null without sigma. z, and scaled, z over the root of 2: columns."""
    s = F.greatest(sigma, F.lit(1e-9))
    return F.when(sigma.isNotNull(), s * (z * (2 * normal_cdf(z, scaled) - 1) + 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) - 1 / math.sqrt(math.pi)))


def regression(p: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, rmse, mae, r2, crps_gaussian, has_predictive_sigma) of predictions (y, pred, sigma)."""
    y, m = F.col("y"), F.col("pred")
    # z in a column of its own, and scaled for the error function there, so that neither is computed for each term
    p = p.select(*keys, "y", "pred", "sigma", ((y - m) / F.greatest(F.col("sigma"), F.lit(1e-9))).alias("__z")).withColumn("__h", F.col("__z") / math.sqrt(2))
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((y - m) * (y - m))).alias("rmse"), F.avg(F.abs(y - m)).alias("mae"),
        (1 - F.sum((y - m) * (y - m)) / (F.var_pop(y) * F.count(y) + 1e-12)).alias("r2"), F.avg(crps(F.col("__z"), F.col("sigma"), F.col("__h"))).alias("crps_gaussian"), (F.count("sigma") > 0).alias("has_predictive_sigma"),
    )


def test_score(task_type: Column) -> Column:
    """The score that a search is judged by on test rows: AUC, or RMSE with its sign turned."""
    return F.when(task_type == "regression", -F.col("rmse")).otherwise(F.col("auc"))


def reliability(p: DataFrame, keys: list[str], bins: int = 12, least: int = 5) -> DataFrame:
    """(keys, bin, n, mean_conf, mean_acc) of bins with `least` rows or more, from binary predictions."""
    s = F.col("score")
    rows = p.select(*keys, F.greatest(s, 1 - s).alias("c"), (F.when(s > 0.5, 1).otherwise(0) == F.col("y")).cast("double").alias("r")).withColumn("bin", bin_of(F.col("c"), bins))
    # rows without a bin count 0: a condition on bin itself would be put before the join that makes the predictions, with all that it is computed from written out for each edge
    return rows.groupBy(*keys, "bin").agg(F.count("bin").alias("n"), F.avg("c").alias("mean_conf"), F.avg("r").alias("mean_acc")).where(F.col("n") >= max(least, 1))
