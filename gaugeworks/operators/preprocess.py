"""Preprocessing fitted on fold 'train': parameters are one-row or per-category aggregates that are joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def impute_standardise(rows: DataFrame, columns: list[str], fold: str = "fold") -> DataFrame:
    """Numeric columns with nulls set to the training mean, then z-scored by the training mean and population deviation after imputation (0 divides by 1).

    A column without any training value is dropped. One pass fits all columns.
    """
    train = rows.where(F.col(fold) == "train")
    m = {c: F.avg(c) for c in columns}
    fit = train.agg(*[m[c].alias(f"{c}__m") for c in columns], *[F.sqrt(F.var_pop(c) * F.count(c) / F.count(F.lit(1))).alias(f"{c}__s") for c in columns]).first()
    known = [c for c in columns if fit[f"{c}__m"] is not None]
    scaled = {c: (F.coalesce(F.col(c).cast("double"), F.lit(fit[f"{c}__m"])) - fit[f"{c}__m"]) / (fit[f"{c}__s"] or 1.0) for c in known}
    return rows.withColumns(scaled).drop(*[c for c in columns if c not in known])


def category(c) -> F.Column:
    """Null and NaN become the token -1."""
    t = c.cast("string")
    return F.when(t.isNull() | (t == "NaN"), "-1").otherwise(t)


def ordinal(rows: DataFrame, column: str, fold: str = "fold", out: str | None = None) -> DataFrame:
    """rows with the place of the category among the sorted training categories from 0; others -1."""
    own = rows.withColumn("__c", category(F.col(column)))
    codes = own.where(F.col(fold) == "train").select("__c").distinct().withColumn("__k", F.row_number().over(Window.orderBy("__c")) - 1)
    return own.join(codes, "__c", "left").withColumn(out or f"{column}_code", F.coalesce("__k", F.lit(-1))).drop("__c", "__k")


def onehot(rows: DataFrame, column: str, fold: str = "fold", out: str | None = None) -> DataFrame:
    """rows with an array of zeros and a one at the training category's place; all zeros for others."""
    coded = ordinal(rows, column, fold, "__code")
    size = rows.where(F.col(fold) == "train").agg(F.count_distinct(category(F.col(column))).cast("int").alias("__n"))
    hot = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda k: F.when(k == F.col("__code"), 1).otherwise(0))
    return coded.crossJoin(F.broadcast(size)).withColumn(out or f"{column}_onehot", F.when(F.col("__n") > 0, hot).otherwise(F.array().cast("array<int>"))).drop("__code", "__n")


def labels(rows: DataFrame, column: str, fold: str = "fold", out: str = "y") -> DataFrame:
    """rows with class labels from 0. A label that training doesn't have is an error, raised here by a count, whatever is selected later."""
    coded = ordinal(rows, column, fold, out)
    unknown = coded.where(F.col(out) < 0).select(column).limit(1).collect()
    if unknown:
        raise ValueError(f"label not in training data: {unknown[0][0]}")
    return coded


def columns(rows: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(name, kind, place) of the feature columns in the order in which learners get them: numeric ones, then categorical ones."""
    lost = [c for c in (*numeric, *categorical) if c not in rows.columns]
    if lost:
        raise ValueError(f"no such columns: {lost}")
    told = [(c, kind, k) for k, (c, kind) in enumerate([*[(c, "numeric") for c in numeric], *[(c, "categorical") for c in categorical]])]
    return rows.sparkSession.createDataFrame(told, "name string, kind string, place int")


def native_categories(rows: DataFrame, categorical: list[str], fold: str = "fold") -> DataFrame:
    """rows with category codes as strings of whole numbers, for learners that take categories as they are; unseen ones are -1."""
    for c in categorical:
        rows = ordinal(rows, c, fold, "__own").withColumn(c, F.col("__own").cast("string")).drop("__own")
    return rows


def standardise_target(rows: DataFrame, y: str, fold: str = "fold") -> DataFrame:
    """rows with y scaled by the training mean and population deviation (plus 1e-12), and reg_mean and reg_std to undo it."""
    fit = rows.where(F.col(fold) == "train").agg(F.avg(y).alias("reg_mean"), F.stddev_pop(y).alias("reg_std"))
    return rows.crossJoin(F.broadcast(fit)).withColumn(y, (F.col(y) - F.col("reg_mean")) / (F.col("reg_std") + 1e-12))


def task_type(declared: DataFrame) -> DataFrame:
    """declared (override, task_type, task, n_classes) with `effective`: override first, then the shipped names by prefix; older `classification` by its classes; and where it comes from."""
    raw = F.lower(F.coalesce("override", "task_type", "task"))
    kind = F.when(F.startswith(raw, F.lit("bin")), "binclass").when(F.startswith(raw, F.lit("multi")), "multiclass").when(F.startswith(raw, F.lit("reg")), "regression").when(raw == "classification", F.when(F.col("n_classes") == 2, "binclass").otherwise("multiclass")).otherwise("unknown")
    return declared.withColumn("effective", kind).withColumn("source", F.when(F.col("override").isNotNull(), "override").when(F.col("task_type").isNotNull() | F.col("task").isNotNull(), "shipped").otherwise("none"))


def dedup_family(members: DataFrame, ids: DataFrame, taken: DataFrame) -> DataFrame:
    """members (member, external_id) without those whose id, their own or else the map's, another family has taken; members without id stay."""
    known = members.join(ids.select("member", F.col("external_id").alias("__mapped")), "member", "left").withColumn("resolved_id", F.coalesce("external_id", "__mapped")).drop("__mapped")
    return known.join(taken.select(F.col("external_id").alias("resolved_id")).where("resolved_id is not null").distinct(), "resolved_id", "left_anti").select(*members.columns, "resolved_id")


def header_counts(lines: DataFrame, order: str, text: str, header: str, item: str, count: str) -> DataFrame:
    """(group, declared, listed, agrees): the number that each header declares against the items listed under it; count: a pattern with one group."""
    listed = fill_headers(lines, order, text, header, item).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    heads = lines.select(F.nullif(F.regexp_extract(text, header, 1), F.lit("")).alias("group"), F.regexp_extract(text, count, 1).try_cast("int").alias("d")).where("group is not null").groupBy("group").agg(F.sum("d").alias("declared"))
    return heads.join(listed, "group", "left").select("group", "declared", F.coalesce("n", F.lit(0)).alias("listed"), F.col("declared").eqNullSafe(F.coalesce("n", F.lit(0))).alias("agrees"))


def fill_headers(lines: DataFrame, order: str, text: str, header: str, item: str) -> DataFrame:
    """Items of a commented list with the last header before them: (order, group, item). header and item are patterns with one group. A file's lines are few."""
    got = lines.withColumn("__h", F.nullif(F.regexp_extract(text, header, 1), F.lit(""))).withColumn("item", F.nullif(F.regexp_extract(text, item, 1), F.lit("")))
    filled = got.withColumn("group", F.last("__h", ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return filled.where("item is not null").select(order, "group", "item")
