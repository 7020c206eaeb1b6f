"""A split's way to a record, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.scalars import EPS
from gaugeworks.session import ship, table

from .queries_stats import _bin, r9

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Six cells out of the vectors: two of two classes, two of three, one of three whose probabilities have two columns, one of three whose two columns are classes 0 and 2;
# every seventh row of seed 1 is not normalised.
_RAW = "abs(embedding[1]::DOUBLE) + 0.05e0 AS a, abs(embedding[2]::DOUBLE) + 0.05e0 AS b, abs(embedding[3]::DOUBLE) + 0.05e0 AS c"
_ASSEMBLED = f"""
WITH r AS (SELECT vec_id, vec_id // 2 % 3 AS m, vec_id % 2 AS seed, {_RAW} FROM embeddings),
w AS (SELECT *, CASE m WHEN 1 THEN 3 ELSE 2 END AS width, CASE m WHEN 0 THEN 2 ELSE 3 END AS k, vec_id // 6 % CASE m WHEN 0 THEN 2 ELSE 3 END AS y, CASE WHEN seed = 1 AND vec_id % 7 = 0 THEN 1e0 ELSE a + b + CASE m WHEN 1 THEN c ELSE 0e0 END END AS tot FROM r),
p AS (SELECT *, CASE m WHEN 0 THEN [a / tot, b / tot] WHEN 1 THEN [a / tot, b / tot, c / tot] ELSE CASE seed WHEN 0 THEN [a / tot, b / tot, 0e0] ELSE [a / tot, 0e0, b / tot] END END AS q FROM w),
d AS (SELECT *, list_sum(q) AS s, max(abs(list_sum(q) - 1)) OVER (PARTITION BY m, seed) AS dev FROM p),
n AS (SELECT *, CASE WHEN dev > 1e-9 THEN list_transform(q, lambda v: v / s) ELSE q END AS z FROM d),
c AS (SELECT *, list_max(z) AS top, (list_position(z, list_max(z)) - 1 = y)::INT AS hit FROM n),
ece AS (SELECT m, seed, sum(x) AS ece FROM (SELECT m, seed, abs(h - f) / sum(c) OVER (PARTITION BY m, seed) AS x FROM (SELECT m, seed, {_bin('top', 15)} AS bin, count(*) AS c, sum(hit) AS h, sum(top) AS f FROM c GROUP BY ALL)) GROUP BY ALL),
g AS (SELECT m, seed, count(*) AS n, md5(string_agg(y::VARCHAR, ',' ORDER BY vec_id)) AS y_md5, round(max(dev), 9) AS deviation, max(dev) > 1e-9 AS renormalised, round(sum(vec_id % 11 * q[2]), 6) AS weighed,
  avg(hit) AS acc, avg(-ln(greatest(least(z[y + 1], 1 - {EPS!r}), {EPS!r}))) AS log_loss, avg(list_sum(list_transform(z, lambda v, i: power(v - CASE WHEN i - 1 = y THEN 1 ELSE 0 END, 2)))) AS brier FROM c GROUP BY m, seed)
SELECT concat('m', m) AS model, seed::INT AS seed, n, y_md5, deviation, renormalised, weighed, CASE WHEN m = 2 THEN 'proba padded 2->3 (unobserved class)' ELSE '' END AS notes, round(acc, 9) AS acc, round(log_loss, 9) AS log_loss, round(brier, 9) AS brier, round(ece, 9) AS ece FROM g JOIN ece USING (m, seed)
"""


@query(_ASSEMBLED)
def record_assembly(spark, sf_dir):
    """Long predictions collected back into records: padded, normalised by the record's own deviation, scored."""
    from gaugeworks.operators import cells  # it needs numpy, which the registry doesn't

    at = lambda k: F.abs(F.element_at("embedding", k).cast("double")) + 0.05
    m, seed = F.expr("vec_id div 2 % 3"), F.col("vec_id") % 2
    v = table(spark, sf_dir, "embeddings").select("vec_id", m.alias("m"), seed.cast("int").alias("seed"), at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    v = v.withColumns({"n_classes": F.when(F.col("m") == 0, 2).otherwise(3), "cell": F.concat_ws("#", "m", "seed"), "by": F.when((F.col("seed") == 1) & (F.col("vec_id") % 7 == 0), 1.0).otherwise(F.col("a") + F.col("b") + F.when(F.col("m") == 1, F.col("c")).otherwise(0.0))})
    over = lambda *names: F.array(*[F.col(x) / F.col("by") for x in names])
    ids = F.when((F.col("m") == 2) & (F.col("seed") == 1), F.array(F.lit(0), F.lit(2)))
    none = F.lit(None).cast("double")
    p = v.select("cell", F.col("vec_id").alias("row"), (F.expr("vec_id div 6") % F.col("n_classes")).cast("double").alias("y"), none.alias("pred"), none.alias("sigma"), F.when(F.col("m") == 1, over("a", "b", "c")).otherwise(over("a", "b")).alias("proba"), ids.alias("ids"))
    units = v.select("cell", F.concat(F.lit("m"), "m").alias("model"), "seed", F.lit("classification").alias("task_type"), "n_classes").distinct()
    got = cells.record(p, units)
    # rows of a cell are vec_ids that are 12 apart in six classes of remainders: their weights from their places
    back = got.select("cell", F.posexplode("proba").alias("at", "q")).join(p.select("cell", "row").withColumn("at", F.expr("row_number() over (partition by cell order by row) - 1")), ["cell", "at"])
    weighed = back.groupBy("cell").agg(F.round(F.sum(F.col("row") % 11 * F.get("q", F.lit(1))), 6).alias("weighed"))
    ys = F.array_join(F.transform("y_true", lambda y: y.cast("int").cast("string")), ",")
    out = got.join(weighed, "cell").select("model", "seed", F.size("y_true").cast("long").alias("n"), F.md5(ys).alias("y_md5"), F.round("proba_max_sum_deviation", 9).alias("deviation"), F.col("proba_renormalised").alias("renormalised"), "weighed", F.array_join("notes", ";").alias("notes"), "metrics.acc", "metrics.log_loss", "metrics.brier", "metrics.ece")
    return r9(out, "deviation", "weighed")


_DESIGN = """
WITH o AS (SELECT concat('core:', o_orderpriority) AS dataset, o_orderkey AS row, o_orderstatus AS label, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_totalprice END AS a FROM orders),
s AS (SELECT *, unnest([0, 1]) AS seed FROM o),
k AS (SELECT *, md5(concat_ws(':', seed, row)) AS key FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY dataset, seed, label ORDER BY key, row) AS pos, count(*) OVER (PARTITION BY dataset, seed, label) AS n FROM k),
f AS (SELECT *, CASE WHEN pos <= round(n * 0.64e0) THEN 'train' WHEN pos <= round(n * 0.64e0) + round((n - round(n * 0.64e0)) * (0.16e0 / 0.36e0)) THEN 'val' ELSE 'test' END AS fold FROM p),
c AS (SELECT dataset, seed, label, row_number() OVER (PARTITION BY dataset, seed ORDER BY label) - 1 AS class FROM (SELECT DISTINCT dataset, seed, label FROM f WHERE fold = 'train')),
m AS (SELECT dataset, seed, avg(a) AS mean, sqrt(var_pop(a) * count(a) / count(*)) AS std FROM f WHERE fold = 'train' GROUP BY ALL)
SELECT dataset, seed::INT AS seed, row, fold, class::DOUBLE AS y, round((coalesce(a, mean) - mean) / std, 6) AS x FROM f JOIN c USING (dataset, seed, label) JOIN m USING (dataset, seed)
"""


@query(_DESIGN)
def split_design(spark, sf_dir):
    """Several datasets and seeds split, their labels coded and numbers standardised, in one job."""
    from gaugeworks.operators import cells  # it needs numpy, which the registry doesn't

    o = table(spark, sf_dir, "orders")
    none = F.lit(None)
    rows = o.select(F.concat(F.lit("core:"), "o_orderpriority").alias("dataset"), F.col("o_orderkey").alias("row"), none.cast("string").alias("shipped"), F.array(F.when(F.col("o_custkey") % 9 != 0, F.col("o_totalprice")).cast("double")).alias("num"), none.cast("array<string>").alias("cat"), none.cast("double").alias("y"), F.col("o_orderstatus").alias("label"))
    infos = rows.select("dataset", F.lit("multiclass").alias("task_type"), none.cast("long").alias("openml_id"), none.cast("string").alias("override")).distinct()
    return cells.design(rows, infos, (0, 1))[0].select("dataset", "seed", "row", "fold", "y", F.round(F.get("num", F.lit(0)), 6).alias("x"))


def _parts(spark, sf_dir):
    """Two datasets of parts: whether one is dear for its size, and its price, from numbers (some missing), brand and type."""
    p = table(spark, sf_dir, "part")
    num = F.array((F.col("p_partkey") % 1000).cast("double"), F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice")).cast("double"))
    one = lambda name, y, label, x: p.select(F.lit(name).alias("dataset"), F.col("p_partkey").alias("row"), F.lit(None).cast("string").alias("shipped"), x.alias("num"), F.array("p_brand", F.split("p_type", " ")[0]).alias("cat"), y.cast("double").alias("y"), label.cast("string").alias("label"))
    dear = (F.col("p_retailprice") + 3 * F.col("p_size") > 1050).cast("int")
    rows = one("core:dear", dear, dear, num).unionByName(one("core:price", F.col("p_retailprice"), F.col("p_retailprice"), F.slice(num, 1, 2)))
    infos = spark.createDataFrame([("core:dear", "binclass", None, None), ("core:price", "regression", None, None)], "dataset string, task_type string, openml_id long, override string")
    return rows, infos


@query()
def boosted_cells(spark, sf_dir):
    """Cells of two datasets, three systems and three protocols, from rows to records; searches are short."""
    from gaugeworks.operators import cells  # it needs numpy, which the registry doesn't

    ship(spark)
    design, told = cells.design(*_parts(spark, sf_dir), (0,))
    asked = [(d, p, m, 0) for d in ("core:dear", "core:price") for p, m in (("cv_standard", "boosted_depth"), ("cv_standard", "boosted_leaves"), ("cv_standard", "boosted_symmetric"), ("cv_standard", "tabicl"), ("matched_hpo", "boosted_leaves"), ("pareto_hpo", "boosted_depth"))]
    got = cells.run(spark.createDataFrame(asked, "dataset string, protocol string, model string, seed int"), design, told, trials=4, batch=4, search_rounds=10, full_rounds=30)
    # a draw by numpy isn't the same on all machines to the last digit
    return got.select("unit", "status", "task_type", "n_classes", F.size("y_true").alias("n_test"), F.round("metrics.auc", 6).alias("auc"), F.round("metrics.rmse", 6).alias("rmse"), F.round("inner_score", 6).alias("inner_score"), F.round("test_score", 6).alias("test_score"), F.round("optimism_gap", 6).alias("optimism_gap"), F.size("pareto_front").alias("n_points"), F.col("gbdt_es.best_iter").alias("best_iter"))
