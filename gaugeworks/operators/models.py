"""Systems that can be fitted here, behind one dispatcher that tells a status instead of raising.

Adapters are pyspark.ml estimators. Systems whose libraries aren't here, tree boosters of other makers, neural and in-context ones, are known by name and limits, and are
`skipped_missing_backend:name`; their limits come first, as a skip by a limit says more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks import session

from . import grid, preprocess, splits


@dataclass
class Split:
    """rows (row, fold, y, features by name); task_type; labels are whole numbers from 0, regression targets are as they are."""

    rows: DataFrame
    task_type: str
    n_classes: int
    numeric: list[str]
    categorical: list[str]

    @property
    def n_features(self) -> int:
        return len(self.numeric) + len(self.categorical)


def _forest(s: Split, seed: int):
    own = (RandomForestRegressor if s.task_type == "regression" else RandomForestClassifier)(labelCol="y", seed=seed, numTrees=40, maxDepth=7)
    return own, lambda e: [(e.maxDepth, [5, 9]), (e.featureSubsetStrategy, ["sqrt", "all"])]


def _boosted(s: Split, seed: int):
    if s.task_type == "multiclass":
        return None  # this estimator takes two classes
    own = (GBTRegressor if s.task_type == "regression" else GBTClassifier)(labelCol="y", seed=seed, maxIter=40, validationIndicatorCol="early_stop", validationTol=0.001)
    return own, lambda e: [(e.maxDepth, [3, 5]), (e.stepSize, [0.05, 0.2])]


def _linear(s: Split, seed: int):
    own = LinearRegression(labelCol="y", regParam=1e-4) if s.task_type == "regression" else LogisticRegression(labelCol="y", regParam=1e-4, family="multinomial")
    return own, lambda e: [(e.regParam, [1e-4, 1e-2, 1.0])]


def _perceptron(s: Split, seed: int):
    if s.task_type == "regression":
        return None
    own = MultilayerPerceptronClassifier(labelCol="y", seed=seed, layers=[max(1, s.n_features), 16, max(2, s.n_classes)], maxIter=100)
    return own, lambda e: [(e.stepSize, [0.03, 0.3])]


#: Adapters by system: what gives an estimator and its search space, or None where it can't take the task.
ADAPTERS: dict[str, Callable] = {"forest": _forest, "boosted": _boosted, "linear": _linear, "perceptron": _perceptron}
#: As (model, kind, regression, tuned); without limits.
OWN = (("forest", "trees", True, True), ("boosted", "gbdt", True, True), ("linear", "linear", True, True), ("perceptron", "nn", False, True))


def limits(spark) -> DataFrame:
    """The table of limits of all systems, those of this module included."""
    own = spark.createDataFrame([(*r, None, None, None, None) for r in OWN], "model string, kind string, regression boolean, tuned boolean, max_features int, max_rows int, max_classes int, max_cells long")
    return grid.caps(spark).unionByName(own)


def prepared(s: Split, seed: int) -> DataFrame:
    """rows with features: numeric columns imputed and scaled, categories as codes, fitted on fold train; and early_stop, the carved share of training rows."""
    rows = preprocess.impute_standardise(s.rows, s.numeric) if s.numeric else s.rows
    for c in s.categorical:
        rows = preprocess.ordinal(rows, c)
    columns = [c for c in s.numeric if c in rows.columns] + [f"{c}_code" for c in s.categorical]
    train = rows.where("fold = 'train'").withColumn("__y", F.lit(0) if s.task_type == "regression" else F.col("y"))
    carved = splits.carve(train.select("row", "__y"), "__y", "row", seed).select("row", "early_stop")
    rows = rows.join(carved, "row", "left").withColumn("early_stop", F.coalesce("early_stop", F.lit(False)))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select("row", "fold", F.col("y").cast("double").alias("y"), "features", "early_stop")


def predict(s: Split, model: str, protocol: str = "cv_standard", seed: int = 0, known: DataFrame | None = None) -> dict:
    """What a system gives for a split: status, and, if that is ok, predictions (row, y, pred, proba) of fold test with notes, inner_score and task_type.

    Under matched_hpo the estimator is searched over its space by five-fold cross-validation, and inner_score is the best mean. Any error is a status.
    """
    spark = s.rows.sparkSession
    try:
        n = s.rows.where("fold = 'train'").count()
        ask = spark.createDataFrame([(model, protocol, s.task_type, s.n_features, n, s.n_classes)], "model string, protocol string, task_type string, n_features int, n_rows int, n_classes int")
        told = grid.capability(ask, limits(spark) if known is None else known).first()
        out = {"status": "ok", "model": model, "protocol": protocol, "seed": seed, "task_type": s.task_type, "n_classes": s.n_classes, "notes": []}
        if told["skip_reason"]:
            return out | {"status": f"skipped_{told['skip_reason']}"}
        made = ADAPTERS[model](s, seed) if model in ADAPTERS else None
        if model not in ADAPTERS:
            return out | {"status": f"skipped_missing_backend:{model}"}
        if made is None:
            return out | {"status": "skipped_task_type"}
        rows = prepared(s, seed).persist()
        try:
            train = rows.where("fold = 'train'")
            if told["support_rows"] < n:
                train = splits.subsample(train, "row", told["support_rows"], seed)
                out["subsampled"] = True
            estimator, space = made
            if protocol == "matched_hpo":
                search = ParamGridBuilder()
                for p, values in space(estimator):
                    search = search.addGrid(p, values)
                scorer = RegressionEvaluator(labelCol="y", metricName="rmse") if s.task_type == "regression" else BinaryClassificationEvaluator(labelCol="y") if s.task_type == "binclass" else MulticlassClassificationEvaluator(labelCol="y", metricName="logLoss")
                stratum = F.lit(0) if s.task_type == "regression" else F.col("y")
                train = splits.folds(train.withColumn("__y", stratum), "__y", "row", seed).drop("__y")
                fitted = CrossValidator(estimator=estimator, estimatorParamMaps=search.build(), evaluator=scorer, numFolds=5, foldCol="inner_fold").fit(train)
                best = max(fitted.avgMetrics) if scorer.isLargerBetter() else -min(fitted.avgMetrics)
                out |= {"inner_score": best, "notes": [f"searched {len(fitted.avgMetrics)} settings"]}
                fitted = fitted.bestModel
            else:
                fitted = estimator.fit(train)
            told = fitted.transform(rows.where("fold = 'test'"))
            proba = vector_to_array("probability") if "probability" in told.columns else F.lit(None).cast("array<double>")
            columns = told.select("row", "y", F.col("prediction").alias("pred"), proba.alias("proba"))
            out["predictions"] = session.stored(columns, "predictions")  # a table, so that rows can be let go
        finally:
            rows.unpersist()
        return out
    except Exception as e:  # any error of a system is its result
        return {"status": f"error:{type(e).__name__}", "model": model, "protocol": protocol, "seed": seed, "task_type": s.task_type, "msg": str(e)[:2000]}
