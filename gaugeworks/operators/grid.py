"""Declared grids, manifests and coverage: set algebra over cells (dataset, protocol, model, seed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import family

#: Protocols that a family may run under.
VALID_PAIRS = (("core", "cv_standard"), ("core", "matched_hpo"), ("cc18", "cv_standard"), ("tabred", "temporal"))
CELL = ["dataset", "protocol", "model", "seed"]


def bucket(status: Column) -> Column:
    return F.when(status == "ok", "ok").when(F.startswith(status, F.lit("error:")), "error").otherwise("skip")


def build(datasets: DataFrame, protocols: DataFrame, models: DataFrame, seeds: DataFrame, valid: DataFrame) -> DataFrame:
    """All cells of the axes whose (family, protocol) is valid. The axes are declared lists; pairs are cut before the larger product is formed."""
    p = datasets.withColumn("family", family(F.col("dataset"))).crossJoin(protocols).join(F.broadcast(valid), ["family", "protocol"], "left_semi")
    return p.crossJoin(models).crossJoin(seeds).select(*CELL)


def missing(grid: DataFrame, done: DataFrame) -> DataFrame:
    return grid.join(done.select(*CELL), CELL, "left_anti")


def first_missing(grid: DataFrame, done: DataFrame, most: int = 20) -> DataFrame:
    """The first cells that are missing, in order, for a message."""
    return missing(grid, done).orderBy(*CELL).limit(most)


def shard(grid: DataFrame, k: int, n: int) -> DataFrame:
    """Cells whose place in the grid's order is k modulo n."""
    return grid.withColumn("place", F.row_number().over(Window.orderBy(*CELL)) - 1).where(F.pmod("place", F.lit(n)) == k)


def coverage(cells: DataFrame) -> DataFrame:
    """(model, family, protocol, n_ok, n_error, n_skip, total, coverage_pct, incomplete), in that order."""
    b = bucket(F.col("status"))
    c = cells.withColumn("family", family(F.col("dataset"))).groupBy("model", "family", "protocol").agg(F.count_if(b == "ok").alias("n_ok"), F.count_if(b == "error").alias("n_error"), F.count_if(b == "skip").alias("n_skip"), F.count(F.lit(1)).alias("total"))
    return c.withColumn("coverage_pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("n_ok"), F.col("total")), F.lit(0.0)), 1)).withColumn("incomplete", F.col("n_ok") < F.col("total")).orderBy("model", "family", "protocol")


def incomplete(cells: DataFrame) -> DataFrame:
    """(model, dataset, protocol, status, seeds): what is not ok, seeds sorted, as often as they occur."""
    return cells.where(bucket(F.col("status")) != "ok").groupBy("model", "dataset", "protocol", "status").agg(F.array_sort(F.collect_list("seed")).alias("seeds"))


def skip_reasons(cells: DataFrame) -> DataFrame:
    """(status, n_pairs, models): distinct (model, dataset) pairs and sorted models of each skip status."""
    return cells.where(F.startswith("status", F.lit("skipped_"))).groupBy("status").agg(F.count_distinct(F.struct("model", "dataset")).alias("n_pairs"), F.array_sort(F.collect_set("model")).alias("models"))


def outside(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """rows that no entry of the allow-list covers; a null model, dataset or protocol of an entry covers all. The list is a configuration: a few entries."""
    fits = [(F.col(f"a.{k}").isNull() | (F.col(f"a.{k}") == F.col(f"r.{k}"))) for k in ("model", "dataset", "protocol")]
    return rows.alias("r").join(F.broadcast(allowed.alias("a")), fits[0] & fits[1] & fits[2], "left_anti")


#: What systems can take, as (model, kind, regression, tuned, features, rows, classes); null is unlimited.
CAPS = (
    ("tabpfn3", "tfm", True, False, 2000, 50000, 160), ("tabpfn25", "tfm", True, False, 2000, 50000, 10), ("tabpfnv2", "tfm", True, False, 500, 10000, 10), ("tabicl", "tfm", False, False, None, 50000, None), ("mitra", "tfm", True, False, None, 5000, 10),
    ("catboost_tuned", "gbdt", True, True, None, None, None), ("xgboost_tuned", "gbdt", True, True, None, None, None), ("lightgbm_tuned", "gbdt", True, True, None, None, None), ("realmlp", "nn", True, True, None, None, None), ("tabm", "nn", True, True, None, None, None),
)


def caps(spark: SparkSession) -> DataFrame:
    """The table of limits; max_cells (rows after the row limit times features) is off, null, unless set."""
    known = spark.createDataFrame(CAPS, "model string, kind string, regression boolean, tuned boolean, max_features int, max_rows int, max_classes int")
    return known.withColumn("max_cells", F.lit(None).cast("long"))


def capability(requests: DataFrame, known: DataFrame, pareto_protocol: str = "pareto_hpo") -> DataFrame:
    """requests (model, protocol, task_type, n_features, n_rows, n_classes) with kind, skip_reason, the first that holds, and support_rows, cut to the system's rows."""
    r = requests.join(F.broadcast(known.withColumn("known", F.lit(True))), "model", "left")
    reg, support = F.col("task_type") == "regression", F.least("n_rows", "max_rows")
    reason = (
        F.when(F.col("known").isNull(), "unknown_model").when(reg & ~F.col("regression"), "no_regression").when(F.col("n_features") > F.col("max_features"), "feature_cap").when(~reg & (F.col("n_classes") > F.col("max_classes")), "class_cap")
        .when(support.cast("long") * F.col("n_features") > F.col("max_cells"), "cell_cap")
        .when((F.col("protocol") == pareto_protocol) & ~F.col("tuned"), "pareto_tunable_only").when((F.col("protocol") == pareto_protocol) & reg, "no_pareto_for_regression")
    )
    return r.select(*requests.columns, "kind", reason.alias("skip_reason"), support.alias("support_rows"))
