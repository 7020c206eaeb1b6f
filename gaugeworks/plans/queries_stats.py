"""Metrics, ranks, tests, resampling and fronts over the derived tables.

Oracles are written apart from the operators: other formulas where there are any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.functions.scalars import EPS, oriented
from gaugeworks.operators import charts, metrics, pareto, ranks, resample, significance

from gaugeworks.session import stored, table

from .derived import ENV, PRED_BIN, PRED_MULTI, PRED_REG, derived, duck  # noqa: F401

CELL = ["model", "dataset", "seed"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r9(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles rounded to 9 digits, as sums depend on order beyond that."""
    return df.select(*[F.round(c, 9).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


# ---- derived inputs

PB, PR, PM = duck(PRED_BIN), duck(PRED_REG), duck(PRED_MULTI)


def _edges(bins: int) -> str:
    return "[" + ", ".join(repr(k * (1.0 / bins)) + ("e0" if "e" not in repr(k * (1.0 / bins)) else "") for k in range(bins)) + ", 1e0]"


def _bin(conf: str, bins: int) -> str:
    return f"(len(list_filter({_edges(bins)}, lambda e: e < {conf})) - 1)"


#: Cell metrics of the binary grid, as CTEs ending in `cells`.
CELLS_SQL = f"""
pb AS ({PB}),
ranked AS (SELECT *, rank() OVER (PARTITION BY model, dataset, seed ORDER BY score) + (count(*) OVER (PARTITION BY model, dataset, seed, score) - 1) / 2e0 AS r FROM pb),
auc AS (SELECT model, dataset, seed, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))) END AS auc FROM ranked GROUP BY ALL),
st AS (SELECT model, dataset, seed, score, sum(y) AS pos, count(*) AS c FROM pb GROUP BY ALL),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(c) OVER w AS seen FROM st WINDOW w AS (PARTITION BY model, dataset, seed ORDER BY score DESC)),
ap AS (SELECT model, dataset, seed, CASE WHEN sum(pos) > 0 THEN sum(pos * (tp / CAST(seen AS DOUBLE))) / sum(pos) END AS pr_auc FROM cum GROUP BY ALL),
cf AS (SELECT *, greatest(score, 1 - score) AS conf, CAST((score > 0.5e0) = (y = 1) AS DOUBLE) AS ok FROM pb),
bins AS (SELECT model, dataset, seed, {_bin('conf', 15)} AS b, count(*) AS n, avg(ok) AS a, avg(conf) AS c FROM cf GROUP BY ALL),
ece AS (SELECT model, dataset, seed, sum(CASE WHEN b BETWEEN 0 AND 14 THEN n * abs(a - c) ELSE 0 END) / sum(n) AS ece FROM bins GROUP BY ALL),
plain AS (SELECT model, dataset, seed, count(*) AS n, avg(ok) AS acc, avg(-ln(greatest(least(CASE WHEN y = 1 THEN score ELSE 1 - score END, 1 - {EPS!r}), {EPS!r}))) AS log_loss, avg(2 * pow(score - y, 2)) AS brier FROM cf GROUP BY ALL),
cells AS (SELECT * FROM plain JOIN auc USING (model, dataset, seed) JOIN ap USING (model, dataset, seed) JOIN ece USING (model, dataset, seed))
"""

REG_SQL = f"""
pr AS ({PR}),
z AS (SELECT *, CASE WHEN sigma IS NOT NULL THEN greatest(sigma, 1e-9) END AS s FROM pr),
zz AS (SELECT *, (y - pred) / s AS z FROM z),
ph AS (SELECT *, CASE WHEN abs(z / sqrt(2e0)) > 5 THEN sign(z) ELSE exp(-z * z / 2) * list_sum(list_transform(range(0, 71), lambda n: power(z / sqrt(2e0), 2 * n + 1) / gamma(n + 1.5e0))) END AS erf FROM zz),
crps AS (SELECT *, s * (z * erf + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) AS crps FROM ph),
reg AS (SELECT model, dataset, seed, count(*) AS n, sqrt(avg(pow(y - pred, 2))) AS rmse, avg(abs(y - pred)) AS mae, 1 - sum(pow(y - pred, 2)) / (var_pop(y) * count(*) + 1e-12) AS r2, avg(crps) AS crps_gaussian, count(sigma) > 0 AS has_predictive_sigma FROM crps GROUP BY ALL)
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary(derived(spark, sf_dir, PRED_BIN), CELL)


def grids(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Means over seeds of oriented metrics. The cells are a stored table: predictions are read once, whatever reads the grids."""
    own = stored(cells(spark, sf_dir), "cells")
    return [stored(ranks.mean_over_seeds(own, oriented(m, F.col(m))).select("model", "dataset", F.round("score", 9).alias("score")).coalesce(1), "grid") for m in names]


def grid(spark: SparkSession, sf_dir: str, metric: str = "auc") -> DataFrame:
    return grids(spark, sf_dir, metric)[0]


def gapped(g: DataFrame) -> DataFrame:
    return g.where(~F.substring(F.md5(F.concat_ws(":", "model", "dataset")), 1, 1).isin("0", "1"))


GRID_SQL = CELLS_SQL + """,
g AS (SELECT model, dataset, round(avg(auc), 9) AS score FROM cells WHERE auc IS NOT NULL GROUP BY ALL),
h AS (SELECT model, dataset, round(avg(-log_loss), 9) AS score FROM cells GROUP BY ALL),
gr AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2e0 AS rk FROM g),
hr AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2e0 AS rk FROM h),
gm AS (SELECT model, avg(rk) AS mean_rank FROM gr GROUP BY model),
hm AS (SELECT model, avg(rk) AS mean_rank FROM hr GROUP BY model)
"""
GAP_SQL = GRID_SQL + ", gg AS (SELECT * FROM g WHERE substr(md5(concat_ws(':', model, dataset)), 1, 1) NOT IN ('0', '1'))"

# ---- cell metrics

_R = lambda names: ", ".join(f"round({x}, 9) AS {x}" for x in names.split())


@query(f"WITH {CELLS_SQL} SELECT model, dataset, seed, n, {_R('auc acc log_loss brier pr_auc ece')} FROM cells")
def cell_metrics_binary(spark, sf_dir):
    return r9(cells(spark, sf_dir))


@query(f"WITH {CELLS_SQL} SELECT model, dataset, seed, n, {_R('auc acc log_loss brier pr_auc ece')} FROM cells")
def cell_metrics_spread(spark, sf_dir):
    """As cell_metrics_binary, by ranges of scores: a cell of any size is spread over all tasks."""
    return r9(metrics.binary(derived(spark, sf_dir, PRED_BIN), CELL, spread=True))


@query(f"WITH {REG_SQL} SELECT model, dataset, seed, n, {_R('rmse mae r2')}, has_predictive_sigma FROM reg")
def cell_metrics_regression(spark, sf_dir):
    return r9(metrics.regression(derived(spark, sf_dir, PRED_REG), CELL).drop("crps_gaussian"))


@query(f"WITH {REG_SQL} SELECT model, dataset, seed, round(crps_gaussian, 6) AS crps_gaussian FROM reg")
def crps_gaussian(spark, sf_dir):
    return metrics.regression(derived(spark, sf_dir, PRED_REG), CELL).select(*CELL, F.round("crps_gaussian", 6).alias("crps_gaussian"))


_K = 10


@query(f"""
WITH pm AS ({PM}), e AS (SELECT model, seed, row_id, y, list_transform(raw[1:{_K}], lambda x: exp(CAST(x AS DOUBLE))) AS e FROM pm), p AS (SELECT model, seed, row_id, y, list_transform(e, lambda x: x / list_sum(e)) AS q FROM e),
c AS (SELECT model, seed, y, list_max(q) AS top, list_position(q, list_max(q)) - 1 = y AS ok, q FROM p),
b AS (SELECT model, seed, {_bin('top', 15)} AS b, count(*) AS n, avg(CAST(ok AS DOUBLE)) AS a, avg(top) AS t FROM c GROUP BY ALL), ece AS (SELECT model, seed, sum(CASE WHEN b BETWEEN 0 AND 14 THEN n * abs(a - t) ELSE 0 END) / sum(n) AS ece FROM b GROUP BY ALL),
l AS (SELECT model, seed, row_id, y, unnest(q) AS s, unnest(range(0, {_K})) AS k FROM p),
plain AS (SELECT model, seed, count(DISTINCT row_id) AS n, count(DISTINCT y) AS seen, avg(CASE WHEN k = y THEN -ln(greatest(least(s, 1 - {EPS!r}), {EPS!r})) END) AS log_loss, sum(pow(s - CASE WHEN k = y THEN 1 ELSE 0 END, 2)) / count(DISTINCT row_id) AS brier FROM l GROUP BY ALL),
acc AS (SELECT model, seed, avg(CAST(ok AS DOUBLE)) AS acc FROM c GROUP BY ALL),
rk AS (SELECT a.model, a.seed, a.k AS side, o.k AS other, a.y = a.k AS pos, rank() OVER (PARTITION BY a.model, a.seed, a.k, o.k ORDER BY a.s) + (count(*) OVER (PARTITION BY a.model, a.seed, a.k, o.k, a.s) - 1) / 2e0 AS r FROM l a JOIN (SELECT unnest(range(0, {_K})) AS k) o ON o.k <> a.k AND (a.y = a.k OR a.y = o.k)),
one AS (SELECT model, seed, side, other, CASE WHEN count_if(pos) > 0 AND count_if(NOT pos) > 0 THEN (sum(CASE WHEN pos THEN r END) - count_if(pos) * (count_if(pos) + 1) / 2e0) / (count_if(pos) * count_if(NOT pos)) END AS auc FROM rk GROUP BY ALL),
auc AS (SELECT model, seed, avg(auc) AS auc FROM one GROUP BY ALL),
st AS (SELECT model, seed, k, s, count_if(y = k) AS pos, count(*) AS c FROM l GROUP BY ALL), cum AS (SELECT *, sum(pos) OVER w AS tp, sum(c) OVER w AS n FROM st WINDOW w AS (PARTITION BY model, seed, k ORDER BY s DESC)),
apk AS (SELECT model, seed, k, CASE WHEN sum(pos) > 0 THEN sum(pos * (tp / CAST(n AS DOUBLE))) / sum(pos) ELSE 0 END AS ap FROM cum GROUP BY ALL), ap AS (SELECT model, seed, avg(ap) AS pr_auc FROM apk GROUP BY ALL)
SELECT model, seed, n, round(CASE WHEN seen = {_K} THEN auc END, 9) AS auc, {_R('acc log_loss brier pr_auc ece')} FROM plain JOIN acc USING (model, seed) JOIN auc USING (model, seed) JOIN ap USING (model, seed) JOIN ece USING (model, seed)
""")
def cell_metrics_multiclass(spark, sf_dir):
    p = derived(spark, sf_dir, PRED_MULTI)
    return r9(metrics.multiclass(p.select("model", "seed", "y", metrics.softmax(F.col("raw"), _K).alias("proba")), ["model", "seed"], _K))


@query(f"""WITH {CELLS_SQL}, b AS (SELECT model, {_bin('conf', 12)} AS bin, count(*) AS n, avg(conf) AS mean_conf, avg(ok) AS mean_acc FROM cf GROUP BY ALL)
SELECT model, bin, n, {_R('mean_conf mean_acc')} FROM b WHERE n >= 5 AND bin BETWEEN 0 AND 11""")
def reliability_curve(spark, sf_dir):
    return r9(metrics.reliability(derived(spark, sf_dir, PRED_BIN), ["model"]))


# ---- scores and ranks


@query(f"""WITH {CELLS_SQL}, {REG_SQL} SELECT 'classification' AS task_type, model, dataset, round(avg(auc), 9) AS primary_score, round(avg(-log_loss), 9) AS proper_score FROM cells WHERE auc IS NOT NULL GROUP BY ALL
UNION ALL SELECT 'regression', model, dataset, round(avg(-rmse), 6), round(avg(-coalesce(crps_gaussian, mae)), 6) FROM reg GROUP BY ALL""")
def oriented_scores(spark, sf_dir):
    c = cells(spark, sf_dir).where("auc is not null").groupBy("model", "dataset").agg(F.round(F.avg(oriented("auc", F.col("auc"))), 9).alias("primary_score"), F.round(F.avg(oriented("log_loss", F.col("log_loss"))), 9).alias("proper_score"))
    own = F.coalesce(oriented("crps_gaussian", F.col("crps_gaussian")), oriented("mae", F.col("mae")))
    r = metrics.regression(derived(spark, sf_dir, PRED_REG), CELL).groupBy("model", "dataset").agg(F.round(F.avg(oriented("rmse", F.col("rmse"))), 6).alias("primary_score"), F.round(F.avg(own), 6).alias("proper_score"))
    return c.select(F.lit("classification").alias("task_type"), "*").unionByName(r.select(F.lit("regression").alias("task_type"), "*"))


@query(f"WITH {REG_SQL} SELECT model, 'regression' AS task_type, 'mae' AS metric, count(*) AS units FROM reg WHERE crps_gaussian IS NULL GROUP BY ALL")
def fallback_usage(spark, sf_dir):
    r = metrics.regression(derived(spark, sf_dir, PRED_REG), CELL)
    used = r.where(F.col("crps_gaussian").isNull() & F.col("mae").isNotNull())
    return used.groupBy("model").agg(F.count(F.lit(1)).alias("units")).select("model", F.lit("regression").alias("task_type"), F.lit("mae").alias("metric"), "units")


@query(f"WITH {GRID_SQL} SELECT model, round(avg(rk), 9) AS mean_rank, count(*) AS n_datasets, round(avg(score), 9) AS mean_score FROM gr GROUP BY model")
def mean_rank_leaderboard(spark, sf_dir):
    return r9(ranks.leaderboard(grid(spark, sf_dir)))


def _greedy_sql(steps: int = 30) -> str:
    """The greedy block unrolled: after each step the models and datasets that are left. A step without gaps changes nothing."""
    out = [GAP_SQL, "m0 AS (SELECT DISTINCT model FROM gg)", "d0 AS (SELECT DISTINCT dataset FROM gg)"]
    for k in range(steps):
        out += [
            f"x{k} AS MATERIALIZED (SELECT model, dataset, CASE WHEN score IS NULL THEN 1 ELSE 0 END AS gap FROM m{k} CROSS JOIN d{k} LEFT JOIN gg USING (model, dataset))",
            f"a{k} AS MATERIALIZED (SELECT model, sum(gap) AS n FROM x{k} GROUP BY model ORDER BY n DESC, model LIMIT 1)",
            f"b{k} AS MATERIALIZED (SELECT dataset, sum(gap) AS n FROM x{k} GROUP BY dataset ORDER BY n DESC, dataset LIMIT 1)",
            f"s{k} AS MATERIALIZED (SELECT a.model, b.dataset, a.n = 0 AS done, a.n >= b.n AND (SELECT count(*) FROM m{k}) > 3 AS drop_model FROM a{k} a CROSS JOIN b{k} b)",
            f"m{k + 1} AS MATERIALIZED (SELECT m.model FROM m{k} m CROSS JOIN s{k} s WHERE NOT (NOT s.done AND s.drop_model AND m.model = s.model))",
            f"d{k + 1} AS MATERIALIZED (SELECT d.dataset FROM d{k} d CROSS JOIN s{k} s WHERE NOT (NOT s.done AND NOT s.drop_model AND d.dataset = s.dataset))",
        ]
    return "WITH " + ", ".join(out) + f" SELECT gg.model, gg.dataset, gg.score FROM gg JOIN m{steps} USING (model) JOIN d{steps} USING (dataset)"


@query(_greedy_sql())
def complete_block(spark, sf_dir):
    return ranks.complete_block(gapped(grid(spark, sf_dir)))


@query(f"WITH {GAP_SQL} SELECT model, dataset, score FROM gg WHERE dataset IN (SELECT dataset FROM gg GROUP BY dataset HAVING count(*) = (SELECT count(DISTINCT model) FROM gg))")
def strict_block(spark, sf_dir):
    return ranks.strict_block(gapped(grid(spark, sf_dir))).select("model", "dataset", "score")


# ---- tests

# variance form of the statistic: another formula than the operator's
_FRIEDMAN = f"""WITH {GRID_SQL}, s AS (SELECT model, sum(rk) AS r FROM gr GROUP BY model), k AS (SELECT count(DISTINCT model) AS k, count(DISTINCT dataset) AS n FROM gr),
v AS (SELECT sum(pow(rk - (k.k + 1) / 2e0, 2)) AS v FROM gr CROSS JOIN k), f AS (SELECT k.k, k.n, (k.k - 1) * (SELECT sum(pow(r - k.n * (k.k + 1) / 2e0, 2)) FROM s) / v.v AS x FROM k CROSS JOIN v)"""


@query(_FRIEDMAN + " SELECT k, n, round(x, 9) AS friedman_chi2, round(exp(-x / 2) * list_sum(list_transform(range(0, CAST((k - 1) / 2 AS INT)), lambda j: power(x / 2, j) / gamma(j + 1))), 9) AS friedman_p, 'ok' AS status FROM f")
def friedman(spark, sf_dir):
    return r9(significance.friedman(grid(spark, sf_dir)))


_CD = "SELECT k, n, ([1.960, 2.343, 2.569, 2.728, 2.850, 2.949, 3.031, 3.102, 3.164, 3.219, 3.268, 3.313, 3.354, 3.391, 3.426, 3.458, 3.489, 3.517, 3.544])[k - 1] * sqrt(k * (k + 1) / (6e0 * n)) AS cd FROM k"


@query(_FRIEDMAN + f" SELECT k, n, round(cd, 9) AS critical_difference FROM ({_CD})")
def nemenyi_cd(spark, sf_dir):
    return r9(significance.critical_difference(grid(spark, sf_dir)))


@query(
    _FRIEDMAN.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", o AS (SELECT model, mean_rank, row_number() OVER (ORDER BY mean_rank, model) AS i FROM gm), c AS ({_CD}),
j AS (SELECT a.i, max(b.i) AS j FROM o a JOIN o b ON b.i >= a.i CROSS JOIN c WHERE b.mean_rank - a.mean_rank <= c.cd GROUP BY a.i),
w AS (SELECT 1 AS i UNION ALL SELECT CASE WHEN j.j > j.i THEN j.j + 1 ELSE j.i + 1 END FROM w JOIN j ON j.i = w.i)
SELECT a.model AS from_model, b.model AS to_model, round(a.mean_rank, 9) AS from_rank, round(b.mean_rank, 9) AS to_rank, b.i - a.i + 1 AS size FROM w JOIN j ON j.i = w.i JOIN o a ON a.i = j.i JOIN o b ON b.i = j.j WHERE j.j > j.i"""
)
def cd_cliques(spark, sf_dir):
    g = grid(spark, sf_dir)
    return r9(significance.cliques(ranks.mean_ranks(ranks.average_rank(g, ["dataset"])), significance.critical_difference(g)))


# exact null distribution of the signed-rank sum for n up to 50, as a recursion over arrays
_COUNTS = "cnt AS (SELECT 0 AS n, list_transform(range(0, 1276), lambda i: CASE WHEN i = 0 THEN 1::BIGINT ELSE 0::BIGINT END) AS cts UNION ALL SELECT n + 1, list_transform(range(0, 1276), lambda i: cts[i + 1] + CASE WHEN i >= n + 1 THEN cts[i - n] ELSE 0 END) FROM cnt WHERE n < 50)"


def _wilcoxon_sql(diffs: str, keys: str, t: str = "wt") -> str:
    """CTEs ending in t(keys, n, w, p_two, p_greater) from `diffs`(keys, d): exact where no difference is zero and none tie."""
    return f"""{t}d AS ({diffs}), {t}r AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY abs(d)) AS r FROM {t}d WHERE d <> 0),
{t}s AS (SELECT {keys}, count(*) AS n, coalesce(sum(CASE WHEN d > 0 THEN r END), 0) AS w FROM {t}r GROUP BY {keys}),
{t} AS (SELECT {keys}, {t}s.n, w, list_sum(cts[w + 1:]) / power(2e0, {t}s.n) AS p_greater, least(1e0, 2 * least(list_sum(cts[w + 1:]), list_sum(cts[1:w + 1])) / power(2e0, {t}s.n)) AS p_two FROM {t}s JOIN cnt ON cnt.n = {t}s.n)"""


_PAIRS = "SELECT a.model AS a, b.model AS b, a.dataset, a.score - b.score AS d FROM g a JOIN g b ON a.dataset = b.dataset AND a.model < b.model"


def _holm_sql(source: str, p: str, tie: str) -> str:
    return f"SELECT *, least(1e0, max(sc) OVER (ORDER BY {p}, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS holm_p FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY {p}, {tie}) + 1) * {p} AS sc FROM {source})"


@query(
    _FRIEDMAN.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", {_COUNTS}, {_wilcoxon_sql(_PAIRS, 'a, b')}, c AS ({_CD}), hp AS ({_holm_sql('wt', 'p_two', 'a, b')})
SELECT hp.a, hp.b, round(p_two, 9) AS wilcoxon_p, round(holm_p, 9) AS holm_p, round(abs(x.mean_rank - y.mean_rank), 9) AS rank_gap, abs(x.mean_rank - y.mean_rank) > cd AS separated_by_cd, holm_p < 0.05 AS significant_holm
FROM hp JOIN gm x ON x.model = hp.a JOIN gm y ON y.model = hp.b CROSS JOIN c"""
)
def wilcoxon_pairs_holm(spark, sf_dir):
    return r9(significance.pairwise(grid(spark, sf_dir)))


B, SEED = 2000, 0


def boot_sql(values: str, keys: str, stage: str, out: str) -> str:
    """CTEs ending in `out`(keys, mean, lo, hi) from `values`(keys, dataset, v), by md5 draws."""
    k = keys.split(", ")
    on = " AND ".join(f"s.{x} = n.{x}" for x in k)
    return f"""{out}v AS ({values}), {out}n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY dataset) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {out}v),
{out}s AS MATERIALIZED (SELECT {keys}, rep, CAST((('0x' || substr(md5(concat_ws(':', {SEED}, '{stage}', rep, i)), 1, 8))::BIGINT) % n AS BIGINT) AS pick FROM {out}n CROSS JOIN (SELECT unnest(range(1, {B + 1})) AS rep)),
{out}d AS (SELECT {', '.join('s.' + x for x in k)}, s.rep, n.v FROM {out}s s JOIN {out}n n ON {on} AND n.i = s.pick),
{out}m AS (SELECT {keys}, rep, avg(v) AS m FROM {out}d GROUP BY {keys}, rep), {out}q AS (SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM {out}m GROUP BY {keys}),
{out} AS (SELECT * FROM (SELECT {keys}, avg(v) AS mean FROM {out}v GROUP BY {keys}) JOIN {out}q USING ({keys}))"""


@query(f"WITH {GRID_SQL}, {boot_sql(_PAIRS.replace(' AS d FROM', ' AS v FROM'), 'a, b', 'delta', 'ci')} SELECT a, b, {_R('mean lo hi')} FROM ci")
def bootstrap_delta_ci(spark, sf_dir):
    return r9(resample.mean_interval(significance.pairs(grid(spark, sf_dir)), ["a", "b"], "d", b=B, seed=SEED))


_CLAIMS = "cm AS (SELECT model, row_number() OVER (ORDER BY avg(score) DESC, model) AS r FROM gg GROUP BY model), cl AS (SELECT a.model || '_beats_' || b.model AS id, a.model AS a, b.model AS b FROM cm a JOIN cm b ON a.r < b.r)"
#: m7 is left out of the block, which has it on two datasets that others have too: its claims are thin.
_BLOCK = f"""blk AS MATERIALIZED (SELECT model, dataset, score FROM gg WHERE model <> 'm7' AND dataset IN (SELECT dataset FROM gg WHERE model <> 'm7' GROUP BY dataset HAVING count(*) = 6)),
thin AS (SELECT * FROM gg WHERE model <> 'm7' OR dataset IN (SELECT DISTINCT dataset FROM blk ORDER BY dataset LIMIT 2)),
ow AS (SELECT * FROM blk UNION ALL SELECT model, dataset, score FROM thin WHERE model NOT IN (SELECT model FROM blk))"""
_CLAIM_D = "SELECT cl.id, x.dataset, x.score - y.score AS {v} FROM cl JOIN ow x ON x.model = cl.a JOIN ow y ON y.model = cl.b AND y.dataset = x.dataset"


_SURVIVAL = f"""WITH RECURSIVE {GAP_SQL}, {_BLOCK}, {_CLAIMS}, {_COUNTS}, {_wilcoxon_sql(_CLAIM_D.format(v='d'), 'id')}, {boot_sql(_CLAIM_D.format(v='v'), 'id', 'survival', 'ci')},
ps AS (SELECT cl.*, coalesce(wt.n, 0) AS n, CASE WHEN wt.n >= 3 THEN p_greater ELSE 1e0 END AS p FROM cl LEFT JOIN wt USING (id)), hp AS ({_holm_sql('ps', 'p', 'id')})
SELECT id, a, b, n AS n_datasets, CASE WHEN n >= 3 THEN round(mean, 9) END AS mean_delta, round(p, 9) AS wilcoxon_p_onesided, CASE WHEN n >= 3 THEN round(lo, 9) END AS ci_lo, CASE WHEN n >= 3 THEN round(hi, 9) END AS ci_hi, a = 'm7' OR b = 'm7' AS outside_complete_block, round(holm_p, 9) AS holm_p,
CAST(CASE WHEN n >= 3 THEN holm_p < 0.05 AND lo > 0 END AS VARCHAR) AS survives FROM hp LEFT JOIN ci USING (id)"""


def _claims(spark, sf_dir):
    g = gapped(grid(spark, sf_dir))
    intervals = lambda d, keys, v: resample.mean_interval(d, keys, v, b=B, seed=SEED, stage="survival")
    block = stored(ranks.strict_block(g.where("model <> 'm7'")).select("model", "dataset", "score").coalesce(1), "block")
    first = block.select("dataset").distinct().orderBy("dataset").limit(2)
    thin = g.where("model <> 'm7'").unionByName(g.where("model = 'm7'").join(first, "dataset", "left_semi").select(*g.columns))
    return r9(significance.survival(significance.claims_of(g), thin, block, intervals))


@query(_SURVIVAL)
def claim_survival(spark, sf_dir):
    return _claims(spark, sf_dir).withColumn("survives", F.col("survives").cast("string"))


@query(f"""SELECT id AS claim_id, a AS A, b AS B, CAST(n_datasets AS VARCHAR) AS n_datasets, printf('%.4f', mean_delta) AS mean_delta, printf('%.4g', wilcoxon_p_onesided) AS wilcoxon_p_onesided, printf('%.4g', holm_p) AS holm_p, printf('%.4f', ci_lo) AS ci_lo, printf('%.4f', ci_hi) AS ci_hi,
CASE survives WHEN 'true' THEN 'True' ELSE 'False' END AS survives FROM ({_SURVIVAL}) WHERE survives IS NOT NULL""")
def claim_table(spark, sf_dir):
    """Table 1: claims with a verdict as text."""
    return charts.claims_table(_claims(spark, sf_dir))


def _times_sql(stage: str) -> str:
    return f"""ds AS (SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT dataset FROM g)),
pick AS (SELECT b.b, d.dataset FROM ds s CROSS JOIN (SELECT unnest(range(1, {B + 1})) AS b) b JOIN ds d ON d.i = (('0x' || substr(md5(concat_ws(':', {SEED}, '{stage}', b.b, s.i)), 1, 8))::BIGINT) % s.n)"""


@query(f"""WITH {GRID_SQL}, {_times_sql('ranks')}, mm AS (SELECT b, model, round(avg(rk), 9) AS m FROM pick JOIN gr USING (dataset) GROUP BY ALL),
rr AS (SELECT b, model, rank() OVER (PARTITION BY b ORDER BY m) + (count(*) OVER (PARTITION BY b, m) - 1) / 2e0 AS r FROM mm)
SELECT model, round(gm.mean_rank, 9) AS point_mean_rank, quantile_cont(r, 0.5) AS median_rank, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM rr JOIN gm USING (model) GROUP BY ALL""")
def rank_stability(spark, sf_dir):
    return r9(resample.rank_bands(grid(spark, sf_dir), b=B, seed=SEED))


_TAU = "SELECT sum(sign(round(x.p - y.p, 9)) * sign(round(x.q - y.q, 9))) / sqrt(sum(pow(sign(round(x.p - y.p, 9)), 2)) * sum(pow(sign(round(x.q - y.q, 9)), 2))) AS tau"


#: Permutations by inversions, and k(tau, tau_p) of t(model, p, q): exact where nothing ties.
_INVERSIONS = "iv AS (SELECT 1 AS n, [1e0] AS c UNION ALL SELECT n + 1, list_transform(range(0, CAST((n + 1) * n / 2 AS BIGINT) + 1), lambda i: list_sum(c[CAST(greatest(1, i - n + 1) AS BIGINT):CAST(least(len(c), i + 1) AS BIGINT)])) FROM iv WHERE n < 10)"
_KENDALL = """ks AS (SELECT count(*) AS m, sum(sx * sy) AS s, sum(sx * sx) AS xx, sum(sy * sy) AS yy FROM (SELECT sign(round(x.p - y.p, 9)) AS sx, sign(round(x.q - y.q, 9)) AS sy FROM t x JOIN t y ON x.model < y.model)),
k AS (SELECT s / sqrt(xx * yy) AS tau, CASE WHEN xx = m AND yy = m THEN least(1e0, 2 * list_sum(c[1:CAST(floor(least((m - s) / 2e0, (m + s) / 2e0)) AS BIGINT) + 1]) / list_sum(c)) END AS tau_p FROM ks JOIN iv ON iv.n = (SELECT count(*) FROM t))"""


@query(f"""WITH RECURSIVE {GRID_SQL}, {_INVERSIONS}, t AS (SELECT gm.model, gm.mean_rank AS p, hm.mean_rank AS q FROM gm JOIN hm USING (model)), {_KENDALL}
SELECT (SELECT count(*) FROM t) AS n_items, round(tau, 9) AS tau, round(tau_p, 9) AS tau_p FROM k""")
def kendall_reorder(spark, sf_dir):
    a, b = (ranks.mean_ranks(ranks.average_rank(g, ["dataset"])) for g in grids(spark, sf_dir, "auc", "log_loss"))
    both = a.select("model", F.col("mean_rank").alias("p")).join(b.select("model", F.col("mean_rank").alias("q")), "model")
    return r9(significance.kendall(both, [], "p", "q").select("n_items", "tau", "tau_p"))


@query(f"WITH {GRID_SQL}, t AS (SELECT model, gm.mean_rank AS rank_a, hm.mean_rank AS rank_b, hm.mean_rank - gm.mean_rank AS shift FROM gm JOIN hm USING (model)), o AS (SELECT *, row_number() OVER (ORDER BY round(abs(shift), 9) DESC, model) AS place FROM t) SELECT model, {_R('rank_a rank_b shift')}, place, place <= 3 AS largest FROM o")
def metric_movers(spark, sf_dir):
    a, b = (ranks.mean_ranks(ranks.average_rank(g, ["dataset"])) for g in grids(spark, sf_dir, "auc", "log_loss"))
    return r9(ranks.movers(a, b))


@query(f"""WITH {GRID_SQL}, {_times_sql('tau')}, mm AS (SELECT b, model, avg(gr.rk) AS p, avg(hr.rk) AS q FROM pick JOIN gr USING (dataset) JOIN hr USING (dataset, model) GROUP BY ALL),
tt AS (SELECT x.b, sum(sign(round(x.p, 9) - round(y.p, 9)) * sign(round(x.q, 9) - round(y.q, 9))) / nullif(sqrt(sum(pow(sign(round(x.p, 9) - round(y.p, 9)), 2)) * sum(pow(sign(round(x.q, 9) - round(y.q, 9)), 2))), 0) AS tau FROM mm x JOIN mm y ON x.b = y.b AND x.model < y.model GROUP BY x.b)
SELECT round(quantile_cont(tau, 0.025), 9) AS lo, round(quantile_cont(tau, 0.975), 9) AS hi, count(tau) AS n_draws FROM tt""")
def tau_bootstrap(spark, sf_dir):
    return r9(resample.tau_interval(*grids(spark, sf_dir, "auc", "log_loss"), b=B, seed=SEED))


def sparse(g: DataFrame) -> DataFrame:
    """Gaps, and one system with two datasets only."""
    return gapped(g).where("model <> 'm7' or dataset in ('Brand#11', 'Brand#12')")


_FLIP = f"""sg AS (SELECT * FROM gg WHERE model <> 'm7' OR dataset IN ('Brand#11', 'Brand#12')),
fp AS (SELECT a.model AS a, b.model AS b, a.dataset, a.score - b.score AS da, c.score - d.score AS db FROM sg a JOIN sg b ON a.dataset = b.dataset AND a.model < b.model JOIN h c ON c.dataset = a.dataset AND c.model = a.model JOIN h d ON d.dataset = a.dataset AND d.model = b.model),
{_COUNTS}, {_wilcoxon_sql('SELECT a, b, dataset, da AS d FROM fp', 'a, b', 'wa')}, {_wilcoxon_sql('SELECT a, b, dataset, db AS d FROM fp', 'a, b', 'wb')},
{boot_sql('SELECT a, b, dataset, da AS v FROM fp', 'a, b', 'flips', 'ca')}, {boot_sql('SELECT a, b, dataset, db AS v FROM fp', 'a, b', 'flips', 'cb')},
nm AS (SELECT DISTINCT model FROM sg), ct AS (SELECT a, b, count(*) AS n FROM fp GROUP BY a, b),
fa AS (SELECT x.model AS a, y.model AS b FROM nm x JOIN nm y ON x.model < y.model),
fl AS (SELECT fa.a, fa.b, coalesce(ct.n, 0) AS n_datasets, CASE WHEN ct.n >= 3 THEN 'ok' ELSE 'insufficient_shared_datasets' END AS status,
CASE WHEN ct.n >= 3 THEN round(ca.mean, 9) END AS mean_a, CASE WHEN ct.n >= 3 THEN round(ca.lo, 9) END AS lo_a, CASE WHEN ct.n >= 3 THEN round(ca.hi, 9) END AS hi_a, CASE WHEN ct.n >= 3 THEN round(wa.p_two, 9) END AS p_a,
CASE WHEN ct.n >= 3 THEN round(cb.mean, 9) END AS mean_b, CASE WHEN ct.n >= 3 THEN round(cb.lo, 9) END AS lo_b, CASE WHEN ct.n >= 3 THEN round(cb.hi, 9) END AS hi_b, CASE WHEN ct.n >= 3 THEN round(wb.p_two, 9) END AS p_b,
CASE WHEN ct.n >= 3 THEN sign(ca.mean) <> sign(cb.mean) AND ca.mean <> 0 AND cb.mean <> 0 END AS sign_flip,
CASE WHEN ct.n >= 3 THEN (['neither', 'one', 'both'])[CAST(wa.p_two < 0.05 AS INT) + CAST(wb.p_two < 0.05 AS INT) + 1] END AS significant
FROM fa LEFT JOIN ct ON ct.a = fa.a AND ct.b = fa.b LEFT JOIN wa ON wa.a = fa.a AND wa.b = fa.b LEFT JOIN wb ON wb.a = fa.a AND wb.b = fa.b LEFT JOIN ca ON ca.a = fa.a AND ca.b = fa.b LEFT JOIN cb ON cb.a = fa.a AND cb.b = fa.b)"""


def _flips(spark, sf_dir):
    a, b = grids(spark, sf_dir, "auc", "log_loss")
    intervals = lambda d, keys, v: resample.mean_interval(d, keys, v, b=B, seed=SEED, stage="flips")
    return charts.axis_flips(stored(sparse(a), "grid"), b, intervals)


@query(f"WITH RECURSIVE {GAP_SQL}, {_FLIP} SELECT * REPLACE (CAST(sign_flip AS VARCHAR) AS sign_flip) FROM fl")
def axis_flips(spark, sf_dir):
    return r9(_flips(spark, sf_dir)).withColumn("sign_flip", F.col("sign_flip").cast("string"))


@query(f"""WITH {GRID_SQL}, e AS (SELECT model, dataset, round(avg(-ece), 9) AS score FROM cells WHERE dataset <> 'Brand#11' AND NOT (model = 'm2' AND dataset = 'Brand#12') GROUP BY ALL), c AS (SELECT model, dataset, round(avg(acc), 9) AS score FROM cells WHERE dataset <> 'Brand#21' GROUP BY ALL),
ds AS (SELECT dataset FROM e INTERSECT SELECT dataset FROM c), ms AS (SELECT model FROM e JOIN ds USING (dataset) GROUP BY model HAVING count(*) = (SELECT count(*) FROM ds) INTERSECT SELECT model FROM c JOIN ds USING (dataset) GROUP BY model HAVING count(*) = (SELECT count(*) FROM ds)),
er AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2e0 AS rk FROM e JOIN ds USING (dataset) JOIN ms USING (model)), cr AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2e0 AS rk FROM c JOIN ds USING (dataset) JOIN ms USING (model)),
t AS (SELECT model, avg(cr.rk) AS p, avg(er.rk) AS q FROM cr JOIN er USING (model, dataset) GROUP BY model), k AS ({_TAU} FROM t x JOIN t y ON x.model < y.model)
SELECT 'ok' AS status, (SELECT count(*) FROM ms) AS n_models, (SELECT count(*) FROM ds) AS n_datasets, (SELECT model FROM t ORDER BY round(p, 9), model LIMIT 1) AS accuracy_leader, (SELECT model FROM t ORDER BY round(q, 9), model LIMIT 1) AS calibration_leader,
(SELECT model FROM t ORDER BY round(p, 9), model LIMIT 1) <> (SELECT model FROM t ORDER BY round(q, 9), model LIMIT 1) AS leader_disagrees, round(tau, 9) AS kendall_tau FROM k""")
def calibration_rank(spark, sf_dir):
    a, b = grids(spark, sf_dir, "acc", "ece")
    return r9(charts.calibration_rank(a.where("dataset <> 'Brand#21'"), b.where("dataset <> 'Brand#11' and not (model = 'm2' and dataset = 'Brand#12')")))


# ---- fronts

_POINTS = f"WITH {CELLS_SQL}, pt AS MATERIALIZED (SELECT model, dataset, round(avg(acc), 9) AS acc, round(avg(ece), 9) AS ece FROM cells GROUP BY ALL), fr AS MATERIALIZED (SELECT p.* FROM pt p WHERE NOT EXISTS (SELECT 1 FROM pt o WHERE o.dataset = p.dataset AND o.acc >= p.acc AND o.ece <= p.ece AND (o.acc > p.acc OR o.ece < p.ece)))"


def points(spark, sf_dir) -> DataFrame:
    return stored(cells(spark, sf_dir).groupBy("model", "dataset").agg(F.round(F.avg("acc"), 9).alias("acc"), F.round(F.avg("ece"), 9).alias("ece")), "points")


@query(_POINTS + " SELECT * FROM fr")
def pareto_front(spark, sf_dir):
    return pareto.front(points(spark, sf_dir), ["dataset"])


@query(_POINTS + ", ref AS (SELECT 1.05e0 * max(ece) AS r FROM pt), d AS (SELECT dataset, acc, ece, coalesce(lag(ece) OVER (PARTITION BY dataset ORDER BY acc DESC, ece), (SELECT r FROM ref)) AS before FROM (SELECT DISTINCT dataset, acc, ece FROM fr)) SELECT dataset, round(sum((before - ece) * acc), 9) AS hypervolume FROM d GROUP BY dataset")
def pareto_hypervolume(spark, sf_dir):
    p = points(spark, sf_dir)
    top = p.agg((1.05 * F.max("ece")).alias("r"))
    return r9(pareto.hypervolume(p.crossJoin(F.broadcast(top)), ["dataset"], F.col("r")))


#: Names by which some systems count as tuned.
_NAMES = {"m1": "m1_tuned", "m2": "tabm"}
_OPERATING = _POINTS + """, og AS MATERIALIZED (SELECT CASE model WHEN 'm1' THEN 'm1_tuned' WHEN 'm2' THEN 'tabm' ELSE model END AS model, avg(acc) AS acc, avg(ece) AS ece FROM pt GROUP BY model),
rt AS (SELECT CASE model WHEN 'm1' THEN 'm1_tuned' WHEN 'm2' THEN 'tabm' ELSE model END AS model, count(*) / CAST((SELECT count(DISTINCT dataset) FROM pt) AS DOUBLE) AS rate FROM fr GROUP BY model),
op AS (SELECT a.model, acc, ece, coalesce(rate, 0) AS on_front_rate, NOT EXISTS (SELECT 1 FROM og o WHERE o.acc >= a.acc AND o.ece <= a.ece AND (o.acc > a.acc OR o.ece < a.ece)) AS on_front, a.model IN ('m1_tuned', 'tabm') AS tuned,
CASE WHEN a.model NOT IN ('m1_tuned', 'tabm') THEN EXISTS (SELECT 1 FROM og o WHERE o.model IN ('m1_tuned', 'tabm') AND o.acc >= a.acc AND o.ece <= a.ece AND (o.acc > a.acc OR o.ece < a.ece)) END AS dominated_by_tuned FROM og a LEFT JOIN rt USING (model))"""


def _operating(spark, sf_dir):
    return pareto.operating(charts.display(points(spark, sf_dir), _NAMES))


@query(_OPERATING + " SELECT model, round(acc, 9) AS acc, round(ece, 9) AS ece, round(on_front_rate, 9) AS on_front_rate, on_front, tuned, CAST(dominated_by_tuned AS VARCHAR) AS dominated_by_tuned FROM op")
def pareto_operating_points(spark, sf_dir):
    return r9(_operating(spark, sf_dir)).withColumn("dominated_by_tuned", F.col("dominated_by_tuned").cast("string"))


@query(_OPERATING + " SELECT model, round(acc, 9) AS acc, round(ece, 9) AS ece, on_front, NOT tuned AS pretrained, coalesce(dominated_by_tuned, false) AS dominated, CASE WHEN on_front THEN row_number() OVER (PARTITION BY on_front ORDER BY acc DESC, model) END AS line_place FROM op")
def pareto_scatter(spark, sf_dir):
    return r9(charts.scatter_rows(_operating(spark, sf_dir)))


#: Records of a search over accuracy and calibration: each has the points of its seed's bins.
_SEARCH = "rec AS (SELECT model, 'pareto_hpo' AS protocol, dataset || '#' || seed AS unit, acc, ece FROM cells)"
_POOLED = f"WITH {CELLS_SQL}, {_SEARCH}, pp AS (SELECT model, unit, 0 AS place, round(acc, 9) AS acc, round(ece, 9) AS ece FROM rec UNION ALL SELECT model, unit, 1, round(acc * 0.9e0, 9), round(ece * 0.5e0, 9) FROM rec), fp AS (SELECT p.*, row_number() OVER (PARTITION BY model ORDER BY unit, place) AS n FROM pp p WHERE NOT EXISTS (SELECT 1 FROM pp o WHERE o.model = p.model AND o.acc >= p.acc AND o.ece <= p.ece AND (o.acc > p.acc OR o.ece < p.ece)))"


def _pooled(spark, sf_dir):
    c = stored(cells(spark, sf_dir).select("model", F.lit("pareto_hpo").alias("protocol"), F.concat("dataset", F.lit("#"), "seed").alias("unit"), "acc", "ece"), "cells")
    point = lambda a, e: F.struct(F.round(a, 9).alias("test_acc"), F.round(e, 9).alias("test_ece"))
    none = F.struct(F.lit(None).cast("double").alias("test_acc"), F.lit(0.1).alias("test_ece"))
    return pareto.pooled(c.withColumn("pareto_front", F.array(point(F.col("acc"), F.col("ece")), point(F.col("acc") * 0.9, F.col("ece") * 0.5), none)))


@query(_POOLED + """, ag AS (SELECT model, count(*) AS n_points, avg(acc) AS mean_acc, avg(ece) AS mean_ece, 1.05e0 * max(ece) AS ref FROM pp GROUP BY model),
d AS (SELECT model, acc, ece, coalesce(lag(ece) OVER (PARTITION BY model ORDER BY acc DESC, ece), ref) AS before FROM (SELECT DISTINCT model, acc, ece FROM fp) JOIN ag USING (model)), hv AS (SELECT model, sum((before - ece) * acc) AS hv FROM d GROUP BY model)
SELECT model, n_points, round(mean_acc, 9) AS mean_acc, round(mean_ece, 9) AS mean_ece, round(hv, 9) AS front_hypervolume FROM ag JOIN hv USING (model)""")
def pareto_per_system(spark, sf_dir):
    return r9(pareto.per_system(_pooled(spark, sf_dir)))


@query(_POOLED + " SELECT model, acc, ece, n FROM fp WHERE n <= 50")
def pareto_front_points(spark, sf_dir):
    return pareto.front_points(_pooled(spark, sf_dir))


@query(_POINTS + " SELECT model, round(count(*) / CAST((SELECT count(DISTINCT dataset) FROM pt) AS DOUBLE), 9) AS on_front_rate FROM fr GROUP BY model")
def pareto_front_rate(spark, sf_dir):
    p = points(spark, sf_dir)
    n = p.agg(F.count_distinct("dataset").alias("n"))
    return r9(pareto.front(p, ["dataset"]).groupBy("model").agg(F.count(F.lit(1)).alias("c")).crossJoin(F.broadcast(n)).select("model", (F.col("c") / F.col("n")).alias("on_front_rate")))


# ---- report rows

#: Two split policies over the same predictions: test rows drawn by md5, and the latest by date. m6 has three datasets only under the first, so its block lacks it.
_RANDOM, _LATE = "SUBSTR(MD5(CAST(row_id AS STRING)), 1, 1) IN ('0', '1', '2')", "day > DATE '1997-06-01'"
_DATED = PRED_BIN.replace(" AS score\nFROM", " AS score, CAST(l_shipdate AS DATE) AS day\nFROM")


def _side_sql(name: str, where: str, more: str) -> str:
    own = CELLS_SQL.replace(f"pb AS ({PB})", f"pb AS (SELECT * FROM ({duck(_DATED)}) WHERE {where} {more})")
    return f"{name} AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2e0 AS rk FROM (WITH {own} SELECT model, dataset, round(avg(auc), 9) AS score FROM cells WHERE auc IS NOT NULL AND model <> 'm6' GROUP BY ALL))"


_SIDES = f"{_side_sql('ga', _RANDOM, '')}, {_side_sql('hb', _LATE, '')}, t AS (SELECT model, p, q FROM (SELECT model, avg(rk) AS p FROM ga GROUP BY model) JOIN (SELECT model, avg(rk) AS q FROM hb GROUP BY model) USING (model))"


def _sides(spark, sf_dir):
    p = derived(spark, sf_dir, _DATED)
    return [stored(ranks.mean_over_seeds(metrics.binary(p.where(where), CELL), oriented("auc", F.col("auc"))).select("model", "dataset", F.round("score", 9).alias("score")), "grid") for where in (f"{_RANDOM} and (model <> 'm6' or dataset in ('Brand#11', 'Brand#12', 'Brand#13'))", _LATE)]


@query(f"WITH RECURSIVE {_INVERSIONS}, {_SIDES}, {_KENDALL} SELECT (SELECT count(*) FROM t) AS n_items, round(tau, 9) AS tau, round(tau_p, 9) AS tau_p, (SELECT count(DISTINCT dataset) FROM ga) AS n_datasets_random, (SELECT count(DISTINCT dataset) FROM hb) AS n_datasets_temporal, 'm6' AS dropped FROM k")
def temporal_reorder(spark, sf_dir):
    return r9(charts.temporal_reorder(*_sides(spark, sf_dir))[1].select("n_items", "tau", "tau_p", "n_datasets_random", "n_datasets_temporal", F.array_join("dropped", ",").alias("dropped")))


@query(f"WITH {_SIDES} SELECT model, round(p, 9) AS rank_a, round(q, 9) AS rank_b, round(abs(q - p), 9) >= 1 AS moved FROM t")
def slope_chart(spark, sf_dir):
    return r9(charts.slope_rows(charts.temporal_reorder(*_sides(spark, sf_dir))[0]))


@query(f"WITH {CELLS_SQL} SELECT CASE model WHEN 'm1' THEN 'First' ELSE model END AS model, round(avg(ece), 9) AS ece FROM cells GROUP BY ALL")
def calibration_chart(spark, sf_dir):
    c = cells(spark, sf_dir)
    return r9(charts.display(charts.mean_calibration(c, c), {"m1": "First"}))


@query(f"""WITH RECURSIVE {GAP_SQL}, {_FLIP} SELECT count(*) AS n_pairs, count_if(status <> 'ok') AS n_pairs_insufficient, count_if(sign_flip) AS n_sign_flips, count_if(sign_flip AND significant = 'both') AS n_sign_flips_both_significant,
count_if(sign_flip AND significant = 'one') AS n_sign_flips_one_significant, count_if(sign_flip AND significant = 'neither') AS n_sign_flips_neither_significant FROM fl""")
def flip_counts(spark, sf_dir):
    return charts.flip_summary(_flips(spark, sf_dir))


@query(_FRIEDMAN + f" SELECT k.k AS block_k, k.n AS block_n, round(c.cd, 9) AS cd_critical_difference FROM k CROSS JOIN ({_CD}) c")
def summary_row(spark, sf_dir):
    g = grid(spark, sf_dir)
    return r9(charts.summary(block=g.agg(F.count_distinct("model").alias("k"), F.count_distinct("dataset").alias("n")), cd=significance.critical_difference(g).select("critical_difference")))


@query(_FRIEDMAN + " SELECT CAST(floor(min(mean_rank) - 0.3) AS INT) AS low, CAST(ceil(max(mean_rank) + 0.3) AS INT) AS high FROM gm")
def cd_axis(spark, sf_dir):
    return charts.cd_axis(ranks.mean_ranks(ranks.average_rank(grid(spark, sf_dir), ["dataset"])))


@query(f"""WITH {GRID_SQL}, s AS (SELECT model, dataset, score FROM g WHERE dataset LIKE 'Brand#1%' AND NOT (model = 'm3' AND dataset = 'Brand#14')), b AS (SELECT * FROM s WHERE dataset IN (SELECT dataset FROM s GROUP BY dataset HAVING count(*) = 7)) SELECT model, dataset, score FROM b""")
def classification_cd_grid(spark, sf_dir):
    """Brands 1x stand for the core family; every other one ran under another protocol."""
    c = stored(cells(spark, sf_dir), "cells").where("not (model = 'm3' and dataset = 'Brand#14')")
    records = c.withColumns({"family": F.when(F.startswith("dataset", F.lit("Brand#1")), "core").otherwise("other"), "protocol": F.lit("cv_standard"), "task_type": F.lit("binclass")})
    return charts.classification_grid(records).select("model", "dataset", F.round("score", 9).alias("score"))


@query(f"""WITH {GRID_SQL}, {_times_sql('ranks')}, mm AS (SELECT b, model, round(avg(rk), 9) AS m FROM pick JOIN gr USING (dataset) GROUP BY ALL),
rr AS (SELECT b, model, rank() OVER (PARTITION BY b ORDER BY m) + (count(*) OVER (PARTITION BY b, m) - 1) / 2e0 AS r FROM mm),
bd AS (SELECT model, quantile_cont(r, 0.5) AS mid, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM rr GROUP BY model)
SELECT model, mid AS median_rank, mid - lo AS below, hi - mid AS above, row_number() OVER (ORDER BY mid, model) <= 3 AS in_top_cluster FROM bd""")
def rank_band_chart(spark, sf_dir):
    return r9(charts.rank_band_rows(stored(resample.rank_bands(grid(spark, sf_dir), b=B, seed=SEED), "bands")))


@query(f"""WITH {GRID_SQL}, {_times_sql('ranks')}, mm AS (SELECT b, model, round(avg(rk), 9) AS m FROM pick JOIN gr USING (dataset) GROUP BY ALL),
rr AS (SELECT b, model, rank() OVER (PARTITION BY b ORDER BY m) + (count(*) OVER (PARTITION BY b, m) - 1) / 2e0 AS r FROM mm),
bd AS (SELECT model, quantile_cont(r, 0.5) AS mid, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM rr GROUP BY model), o AS (SELECT *, row_number() OVER (ORDER BY mid, model) AS place FROM bd)
SELECT model, place, (SELECT hi FROM o WHERE place = 1) >= lo AS overlaps_leader FROM o WHERE place <= 3""")
def top_cluster(spark, sf_dir):
    return resample.top_cluster(stored(resample.rank_bands(grid(spark, sf_dir), b=B, seed=SEED), "bands")).select("model", "place", "overlaps_leader")


@query(f"""WITH {GRID_SQL}, e AS (SELECT model, avg(rk) AS q FROM (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY s DESC) + (count(*) OVER (PARTITION BY dataset, s) - 1) / 2e0 AS rk FROM (SELECT model, dataset, round(avg(-ece), 9) AS s FROM cells GROUP BY ALL)) GROUP BY model),
a AS (SELECT model, avg(rk) AS p FROM (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY s DESC) + (count(*) OVER (PARTITION BY dataset, s) - 1) / 2e0 AS rk FROM (SELECT model, dataset, round(avg(acc), 9) AS s FROM cells GROUP BY ALL)) GROUP BY model),
ld AS (SELECT model FROM (SELECT model FROM a ORDER BY round(p, 9), model LIMIT 1) UNION SELECT model FROM (SELECT model FROM e ORDER BY round(q, 9), model LIMIT 1)),
u AS (SELECT model, min(dataset || '#' || seed) AS unit FROM cf JOIN ld USING (model) GROUP BY model), b AS (SELECT cf.model, {_bin('conf', 12)} AS bin, count(*) AS n, avg(conf) AS mean_conf, avg(ok) AS mean_acc FROM cf JOIN u ON u.model = cf.model AND u.unit = cf.dataset || '#' || cf.seed GROUP BY ALL)
SELECT model, bin, n, {_R('mean_conf mean_acc')} FROM b WHERE n >= 5 AND bin BETWEEN 0 AND 11""")
def reliability_of_leaders(spark, sf_dir):
    p = derived(spark, sf_dir, PRED_BIN).withColumn("unit", F.concat("dataset", F.lit("#"), "seed"))
    lead = charts.calibration_rank(*grids(spark, sf_dir, "acc", "ece"))
    return r9(charts.leaders_curves(p, lead, lambda units: metrics.reliability(p.join(F.broadcast(units), ["model", "unit"], "left_semi"), ["model"])))


@query(f"WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_linenumber = 1 THEN 'regression' ELSE 'binclass' END AS task_type, l_tax AS auc, l_discount AS rmse FROM lineitem) SELECT row_id, CASE WHEN task_type = 'regression' THEN -rmse ELSE auc END AS test_score FROM c")
def test_score(spark, sf_dir):
    task = F.when(F.col("l_linenumber") == 1, "regression").otherwise("binclass")
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), task.alias("task_type"), F.col("l_tax").alias("auc"), F.col("l_discount").alias("rmse")).select("row_id", metrics.test_score(F.col("task_type")).alias("test_score"))


@query(f"""WITH RECURSIVE {_COUNTS}, s AS (SELECT o_orderpriority AS k, CAST(o_orderkey AS VARCHAR) AS dataset, CAST(o_custkey % 7 AS DOUBLE) - 3 AS d FROM orders), r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY k, abs(d)) - 1) / 2e0 AS r FROM s WHERE d <> 0 WINDOW w AS (PARTITION BY k ORDER BY abs(d))),
t AS (SELECT k, sum(c * c * c - c) AS tt FROM (SELECT k, abs(d) AS m, count(*) AS c FROM r GROUP BY ALL) GROUP BY k), w AS (SELECT k, count(*) AS m, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w FROM r GROUP BY k), n AS (SELECT k, count(*) AS n FROM s GROUP BY k)
SELECT k, n, m AS n_nonzero, round(w, 6) AS w_plus, round((w - m * (m + 1) / 4e0) / sqrt((m * (m + 1) * (2 * m + 1) - tt / 2e0) / 24e0), 6) AS z FROM w JOIN t USING (k) JOIN n USING (k)""")
def wilcoxon_ties_zeros(spark, sf_dir):
    """Ties, zeros and many rows: the normal form's statistic."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderkey").cast("string").alias("dataset"), (F.col("o_custkey") % 7).cast("double").alias("d")).withColumn("d", F.col("d") - 3)
    return significance.wilcoxon(d, ["k"], keep_z=True).select("k", "n", "n_nonzero", F.round("w_plus", 6).alias("w_plus"), F.round("z", 6).alias("z"))
