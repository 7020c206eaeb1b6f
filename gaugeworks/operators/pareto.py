"""Fronts of accuracy (higher better) against calibration error (lower better)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .charts import complete_on


def front(points: DataFrame, keys: list[str], gain: str = "acc", loss: str = "ece") -> DataFrame:
    """points that no other point of the same keys dominates; equal points stay together.

    A point is dominated if one of at least its gain has less loss, or one of more gain has no more loss: running
    minima in order of gain tell both, so that no pairs are formed.
    """
    rows = points.where(F.col(gain).isNotNull() & F.col(loss).isNotNull())
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    # distinct gains by rank, so that "more gain" is a range
    r = rows.withColumn("__r", F.dense_rank().over(by.orderBy(F.desc(gain))))
    order = by.orderBy("__r")
    best = r.withColumn("__le", F.min(loss).over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("__lt", F.min(loss).over(order.rangeBetween(Window.unboundedPreceding, -1)))
    return best.where((F.col(loss) <= F.col("__le")) & (F.col("__lt").isNull() | (F.col("__lt") > F.col(loss)))).drop("__r", "__le", "__lt")


def hypervolume(points: DataFrame, keys: list[str], reference: Column, gain: str = "acc", loss: str = "ece") -> DataFrame:
    """(keys, hypervolume): the area that the points dominate, to gain 0 and loss `reference` (over the point columns)."""
    rows = points.withColumn("__ref", reference).where(F.col(gain).isNotNull() & F.col(loss).isNotNull() & (F.col(loss) < F.col("__ref")) & (F.col(gain) > 0))
    tops = rows.groupBy(*keys, gain, "__ref").agg(F.min(loss).alias(loss))
    by = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(F.desc(gain))
    step = tops.withColumn("__before", F.coalesce(F.min(loss).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col("__ref")))
    return step.groupBy(*keys).agg(F.sum(F.when(F.col("__before") > F.col(loss), (F.col("__before") - F.col(loss)) * F.col(gain)).otherwise(0.0)).alias("hypervolume"))


def dominated_by(points: DataFrame, others: DataFrame, gain: str = "acc", loss: str = "ece") -> DataFrame:
    """points with `dominated`: whether any of the others is at least as good in both and better in one. The others are few (baseline systems)."""
    o = others.select(F.col(gain).alias("__g"), F.col(loss).alias("__l"))
    worse = (F.col("__g") >= F.col(gain)) & (F.col("__l") <= F.col(loss)) & ((F.col("__g") > F.col(gain)) | (F.col("__l") < F.col(loss)))
    hit = points.join(o, worse, "left_semi").withColumn("dominated", F.lit(True))
    return hit.unionByName(points.join(o, worse, "left_anti").withColumn("dominated", F.lit(False)))


#: Systems that are tuned though their names don't say so.
TUNED = ("realmlp", "tabm")


def tuned(model: Column) -> Column:
    return F.endswith(model, F.lit("_tuned")) | model.isin(*TUNED)


def operating(points: DataFrame) -> DataFrame:
    """(model, acc, ece, on_front_rate, on_front, tuned, dominated_by_tuned) of the systems that have every dataset.

    points: model, dataset, acc, ece. Means over datasets are the operating points; on_front_rate, the share of datasets on whose front a system is;
    on_front, whether its operating point is on the front of all; dominated_by_tuned, null for tuned systems.
    """
    own, _ = complete_on(points, points)
    at = own.groupBy("model").agg(F.avg("acc").alias("acc"), F.avg("ece").alias("ece"), F.count(F.lit(1)).alias("__n")).withColumn("tuned", tuned(F.col("model")))
    rate = front(own, ["dataset"]).groupBy("model").agg(F.count(F.lit(1)).alias("__c"))
    best = front(at.select("model", "acc", "ece"), []).select("model", F.lit(True).alias("on_front"))
    told = dominated_by(at.where("not tuned"), at.where("tuned")).select("model", F.col("dominated").alias("dominated_by_tuned"))
    out = at.join(rate, "model", "left").join(best, "model", "left").join(told, "model", "left")
    return out.select("model", "acc", "ece", (F.coalesce("__c", F.lit(0)) / F.col("__n")).alias("on_front_rate"), F.coalesce("on_front", F.lit(False)).alias("on_front"), "tuned", "dominated_by_tuned")


def pooled(records: DataFrame, protocol: str = "pareto_hpo", unit: str = "unit") -> DataFrame:
    """(model, unit, place, acc, ece): the known points of all of a system's records under the protocol, in order of unit and place."""
    at = records.where((F.col("protocol") == protocol) & (F.size("pareto_front") > 0)).select("model", F.col(unit).alias("unit"), F.posexplode("pareto_front").alias("place", "p"))
    return at.select("model", "unit", "place", F.col("p.test_acc").alias("acc"), F.col("p.test_ece").alias("ece")).where("acc is not null and ece is not null")


def per_system(points: DataFrame) -> DataFrame:
    """(model, n_points, mean_acc, mean_ece, front_hypervolume) of pooled points; the reference point is accuracy 0 and 1.05 times the system's largest error."""
    own = points.groupBy("model").agg(F.count(F.lit(1)).alias("n_points"), F.avg("acc").alias("mean_acc"), F.avg("ece").alias("mean_ece"), (1.05 * F.max("ece")).alias("__top"))
    area = hypervolume(points.join(own.select("model", "__top"), "model"), ["model"], F.col("__top")).select("model", F.col("hypervolume").alias("front_hypervolume"))
    return own.join(area, "model", "left").select("model", "n_points", "mean_acc", "mean_ece", F.coalesce("front_hypervolume", F.lit(0.0)).alias("front_hypervolume"))


def front_points(points: DataFrame, most: int = 50) -> DataFrame:
    """(model, acc, ece, n): the first `most` points of each system's front, in pooled order."""
    on = front(points, ["model"]).withColumn("n", F.row_number().over(Window.partitionBy("model").orderBy("unit", "place")))
    return on.where(F.col("n") <= most).select("model", "acc", "ece", "n")
