"""Splits, samples and preprocessing over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import metrics, preprocess, splits
from gaugeworks.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _md5(seed: int, row: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {row}))"


_FOLD = f"""o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_md5(3, 'o_orderkey')}, o_orderkey) AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
o2 AS (SELECT * EXCLUDE (pos, n), row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_md5(3, 'o_orderkey')}, o_orderkey) AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM o WHERE pos > round(n * 0.64e0)),
f AS (SELECT * EXCLUDE (pos, n), 'train' AS fold FROM o WHERE pos <= round(n * 0.64e0) UNION ALL SELECT * EXCLUDE (pos, n), CASE WHEN pos <= round(n * (0.16e0 / (1 - 0.64e0))) THEN 'val' ELSE 'test' END FROM o2)"""


def _folded(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return splits.holdout(o, "o_orderstatus", "o_orderkey", 3)


_DECILES = "[" + ", ".join(f"{k / 10!r}e0" for k in range(11)) + "]"
_BINNED = "greatest(len(list_filter(list_distinct(e), lambda x: x < o_totalprice)) - 1, 0)"


@query(f"""WITH q AS (SELECT quantile_cont(o_totalprice, {_DECILES}) AS e FROM orders), s AS (SELECT o_orderkey, o_totalprice, {_BINNED} AS st FROM orders CROSS JOIN q),
o AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY {_md5(7, 'o_orderkey')}, o_orderkey) AS pos, count(*) OVER (PARTITION BY st) AS n FROM s), r AS (SELECT o_orderkey, o_totalprice FROM o WHERE pos > round(n * 0.64e0)),
q2 AS (SELECT quantile_cont(o_totalprice, {_DECILES}) AS e FROM r), s2 AS (SELECT o_orderkey, {_BINNED} AS st FROM r CROSS JOIN q2),
o2 AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY {_md5(7, 'o_orderkey')}, o_orderkey) AS pos, count(*) OVER (PARTITION BY st) AS n FROM s2)
SELECT o_orderkey, 'train' AS fold FROM o WHERE pos <= round(n * 0.64e0) UNION ALL SELECT o_orderkey, CASE WHEN pos <= round(n * (0.16e0 / (1 - 0.64e0))) THEN 'val' ELSE 'test' END FROM o2""")
def regression_split(spark, sf_dir):
    return splits.holdout(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 7, continuous=True).select("o_orderkey", "fold")


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_md5(6, 'c_custkey')}, c_custkey) <= round(count(*) OVER () * 0.15e0) AS early_stop FROM customer")
def early_stop_unstratified(spark, sf_dir):
    """A stratum of one row, so that all rows are carved alike."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return splits.carve(c.withColumn("s", F.col("c_custkey") == 1), "s", "c_custkey", 6).select("c_custkey", "early_stop")


@query(f"WITH {_FOLD} SELECT o_orderkey, o_orderstatus, fold FROM f")
def stratified_split(spark, sf_dir):
    return _folded(spark, sf_dir).select("o_orderkey", "o_orderstatus", "fold")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM orders)
SELECT o_orderkey, greatest(len(list_filter(list_distinct(e), lambda x: x < o_totalprice)) - 1, 0) AS stratum FROM orders CROSS JOIN q""")
def quantile_strata(spark, sf_dir):
    return splits.strata(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "stratum")


@query(f"SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_md5(5, 'o_orderkey')}, o_orderkey) - 1) % 5 AS inner_fold FROM orders")
def inner_folds(spark, sf_dir):
    return splits.folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5).select("o_orderkey", "inner_fold")


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_md5(6, 'o_orderkey')}, o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.15e0) AS early_stop FROM orders")
def early_stop_carve(spark, sf_dir):
    return splits.carve(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 6).select("o_orderkey", "early_stop")


@query("WITH s AS (SELECT o_orderkey, epoch(o_orderdate) AS t FROM orders), c AS (SELECT quantile_cont(t, 0.64) AS a, quantile_cont(t, 0.8) AS b FROM s) SELECT o_orderkey, CASE WHEN t <= a THEN 'train' WHEN t <= b THEN 'val' ELSE 'test' END AS fold FROM s CROSS JOIN c")
def temporal_split(spark, sf_dir):
    return splits.temporal(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").select("o_orderkey", "fold")


@query(f"SELECT o_orderkey FROM orders ORDER BY {_md5(9, 'o_orderkey')}, o_orderkey LIMIT 500")
def subsample(spark, sf_dir):
    return splits.subsample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500, 9)


_STRATA = """t AS (SELECT p_brand, CASE WHEN min(p_partkey) % 2 = 0 THEN 'binclass' ELSE 'regression' END AS task, CAST(sum(p_size) AS BIGINT) AS n FROM part GROUP BY p_brand),
l AS (SELECT task, list(n ORDER BY n) AS s FROM t GROUP BY task),
st AS (SELECT p_brand, task, n, task || ':' || CASE WHEN n <= CASE WHEN len(s) < 3 THEN s[1] ELSE s[len(s) // 3 + 1] END THEN 'small' WHEN n <= CASE WHEN len(s) < 3 THEN s[-1] ELSE s[2 * len(s) // 3 + 1] END THEN 'medium' ELSE 'large' END AS stratum FROM t JOIN l USING (task)),
q AS (SELECT stratum, n, CAST(f + CASE WHEN o <= 10 - sum(f) OVER () THEN 1 ELSE 0 END AS INT) AS quota FROM (SELECT *, row_number() OVER (ORDER BY round(x - f, 9) DESC, stratum) AS o FROM (SELECT *, floor(x) AS f FROM (SELECT stratum, count(*) AS n, count(*) * 10e0 / sum(count(*)) OVER () AS x FROM st GROUP BY stratum))))"""


def _items(spark, sf_dir):
    t = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.when(F.min("p_partkey") % 2 == 0, "binclass").otherwise("regression").alias("task"), F.sum("p_size").cast("long").alias("n"))
    return splits.size_strata(t, "task", "n")


@query(f"WITH {_STRATA} SELECT p_brand, task, n, stratum FROM st")
def size_strata(spark, sf_dir):
    return _items(spark, sf_dir).select("p_brand", "task", "n", "stratum")


@query(f"WITH {_STRATA} SELECT stratum, n, quota FROM q")
def strata_quota(spark, sf_dir):
    return splits.quota(_items(spark, sf_dir), "stratum", 10)


@query(f"""WITH {_STRATA}, a AS (SELECT st.*, row_number() OVER (PARTITION BY stratum ORDER BY {_md5(4, 'p_brand')}, p_brand) AS pos FROM st),
b AS (SELECT p_brand, stratum, row_number() OVER (ORDER BY pos > quota, {_md5(4, 'p_brand')}, p_brand) AS place FROM a JOIN q USING (stratum)) SELECT p_brand, stratum FROM b WHERE place <= 10""")
def strata_draw(spark, sf_dir):
    return splits.draw(_items(spark, sf_dir), "stratum", "p_brand", 10, 4).select("p_brand", "stratum")


_NUM = "x AS (SELECT o_orderkey, fold, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS a, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS b FROM f)"


def _numeric(spark, sf_dir):
    return _folded(spark, sf_dir).select("o_orderkey", "fold", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("a"), F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey").cast("double")).alias("b"))


@query(f"""WITH {_FOLD}, {_NUM}, m AS (SELECT avg(a) AS ma, avg(b) AS mb FROM x WHERE fold = 'train'), i AS (SELECT o_orderkey, fold, coalesce(a, ma) AS a, coalesce(b, mb) AS b, ma, mb FROM x CROSS JOIN m), s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM i WHERE fold = 'train')
SELECT o_orderkey, fold, round((a - ma) / sa, 6) AS a, round((b - mb) / sb, 6) AS b FROM i CROSS JOIN s""")
def impute_standardise(spark, sf_dir):
    return preprocess.impute_standardise(_numeric(spark, sf_dir), ["a", "b"]).withColumns({c: F.round(c, 6) for c in "ab"})


_CAT = "x AS (SELECT o_orderkey, fold, CASE WHEN o_orderkey % 9 = 0 THEN '-1' WHEN fold = 'test' AND o_orderpriority = '2-HIGH' THEN '2-UNSEEN' ELSE o_orderpriority END AS c FROM f), k AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT c FROM x WHERE fold = 'train'))"


def _categorical(spark, sf_dir):
    unseen = (F.col("fold") == "test") & (F.col("o_orderpriority") == "2-HIGH")
    return _folded(spark, sf_dir).select("o_orderkey", "fold", F.when(F.col("o_orderkey") % 9 != 0, F.when(unseen, "2-UNSEEN").otherwise(F.col("o_orderpriority"))).alias("c"))


@query(f"WITH {_FOLD}, {_CAT} SELECT o_orderkey, fold, coalesce(k, -1) AS c_code FROM x LEFT JOIN k USING (c)")
def ordinal_encode(spark, sf_dir):
    return preprocess.ordinal(_categorical(spark, sf_dir), "c").select("o_orderkey", "fold", "c_code")


@query(f"WITH {_FOLD}, {_CAT} SELECT o_orderkey, fold, array_to_string(list_transform(range(0, (SELECT count(*) FROM k)), lambda i: CASE WHEN i = k THEN 1 ELSE 0 END), '') AS c_onehot FROM x LEFT JOIN k USING (c)")
def onehot_encode(spark, sf_dir):
    return preprocess.onehot(_categorical(spark, sf_dir), "c").select("o_orderkey", "fold", F.array_join(F.transform("c_onehot", lambda x: x.cast("string")), "").alias("c_onehot"))


@query(f"WITH {_FOLD}, m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM f WHERE fold = 'train') SELECT o_orderkey, round((o_totalprice - m) / (s + 1e-12), 6) AS o_totalprice, round(m, 4) AS reg_mean, round(s, 4) AS reg_std FROM f CROSS JOIN m")
def target_standardise(spark, sf_dir):
    r = preprocess.standardise_target(_folded(spark, sf_dir), "o_totalprice")
    return r.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), F.round("reg_mean", 4).alias("reg_mean"), F.round("reg_std", 4).alias("reg_std"))


@query("""WITH d AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'Regression' END AS o, (['binclass', 'multiclass', 'classification', 'reg', 'other'])[p_partkey % 5 + 1] AS t, CAST(p_size % 3 + 1 AS INT) AS k FROM part), r AS (SELECT *, lower(coalesce(o, t)) AS raw FROM d)
SELECT p_partkey, CASE WHEN starts_with(raw, 'bin') THEN 'binclass' WHEN starts_with(raw, 'multi') THEN 'multiclass' WHEN starts_with(raw, 'reg') THEN 'regression' WHEN raw = 'classification' THEN CASE WHEN k = 2 THEN 'binclass' ELSE 'multiclass' END ELSE 'unknown' END AS effective, CASE WHEN o IS NOT NULL THEN 'override' ELSE 'shipped' END AS source FROM r""")
def task_type_resolve(spark, sf_dir):
    k = F.col("p_partkey")
    shipped = F.element_at(F.array(*map(F.lit, ("binclass", "multiclass", "classification", "reg", "other"))), (k % 5 + 1).cast("int"))
    d = table(spark, sf_dir, "part").select(k, F.when(k % 9 == 0, "Regression").alias("override"), shipped.alias("task_type"), F.lit(None).cast("string").alias("task"), (F.col("p_size") % 3 + 1).alias("n_classes"))
    return preprocess.task_type(d).select("p_partkey", "effective", "source")


@query("""WITH m AS (SELECT p_partkey AS member, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 50 END AS external_id FROM part), i AS (SELECT p_partkey AS member, p_partkey % 40 AS e FROM part WHERE p_partkey % 2 = 0), t AS (SELECT DISTINCT s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 1),
r AS (SELECT member, m.external_id, coalesce(m.external_id, i.e) AS resolved_id FROM m LEFT JOIN i USING (member)) SELECT * FROM r WHERE resolved_id IS NULL OR resolved_id NOT IN (SELECT id FROM t)""")
def dedup_family(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    members = p.select(k.alias("member"), F.when(k % 3 == 0, k % 50).alias("external_id"))
    ids = p.where(k % 2 == 0).select(k.alias("member"), (k % 40).alias("external_id"))
    return preprocess.dedup_family(members, ids, table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 1").select(F.col("s_suppkey").alias("external_id")))


def _lines(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.when(k % 10 == 0, F.concat(F.lit("# --- "), "c_mktsegment", F.lit(" (5)"))).when(k % 10 == 5, "").otherwise(F.concat(F.lit("  - "), "c_name"))
    return table(spark, sf_dir, "customer").select(k.alias("line_no"), line.alias("line"))


@query("""WITH l AS (SELECT c_custkey AS line_no, CASE WHEN c_custkey % 10 = 0 THEN '# --- ' || c_mktsegment || ' (5)' WHEN c_custkey % 10 = 5 THEN '' ELSE '  - ' || c_name END AS line FROM customer), h AS (SELECT *, CASE WHEN line LIKE '#%' THEN regexp_extract(line, '--- (\\w+)', 1) END AS h FROM l)
SELECT line_no, "group", item FROM (SELECT line_no, last_value(h IGNORE NULLS) OVER (ORDER BY line_no) AS "group", CASE WHEN line LIKE '  - %' THEN substr(line, 5) END AS item FROM h) WHERE item IS NOT NULL""")
def header_fill_forward(spark, sf_dir):
    return preprocess.fill_headers(_lines(spark, sf_dir), "line_no", "line", r"^#.*--- (\w+)", r"^  - (.*)$")


@query("""WITH h AS (SELECT c_mktsegment AS "group", CAST(sum(5) AS BIGINT) AS declared FROM customer WHERE c_custkey % 10 = 0 GROUP BY 1), l AS (SELECT "group", count(*) AS n FROM (SELECT c_custkey, last_value(CASE WHEN c_custkey % 10 = 0 THEN c_mktsegment END IGNORE NULLS) OVER (ORDER BY c_custkey) AS "group" FROM customer) WHERE c_custkey % 10 NOT IN (0, 5) GROUP BY 1)
SELECT "group", declared, coalesce(n, 0) AS listed, declared = coalesce(n, 0) AS agrees FROM h LEFT JOIN l USING ("group")""")
def header_counts(spark, sf_dir):
    return preprocess.header_counts(_lines(spark, sf_dir), "line_no", "line", r"^#.*--- (\w+)", r"^  - (.*)$", r"\((\d+)\)")


@query(f"""WITH c AS (SELECT c_custkey, c_mktsegment AS s, c_acctbal AS p FROM customer), d AS (SELECT *, ['a', 'b', 'c'][CAST(c_custkey % 3 AS INT) + 1] AS x1 FROM c)
SELECT c_custkey, CASE x1 WHEN 'a' THEN 0.2e0 WHEN 'b' THEN 0e0 ELSE 0.5e0 END AS p0, CASE x1 WHEN 'a' THEN 0.8e0 WHEN 'b' THEN 1e0 ELSE 0.25e0 END AS p1, CASE x1 WHEN 'c' THEN 0.25e0 ELSE 0e0 END AS p2, false AS proba_renormalised FROM d""")
def probability_padding(spark, sf_dir):
    """Columns of some classes only, by class id, made columns of all three."""
    which = F.col("c_custkey") % 3
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(which == 0, F.array(F.lit(0.2), F.lit(0.8))).when(which == 1, F.array(F.lit(1.0))).otherwise(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25))).alias("proba"), F.when(which == 0, F.array(F.lit(0), F.lit(1))).when(which == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(2), F.lit(0), F.lit(1))).alias("ids"))
    full = rows.select("c_custkey", metrics.padded(F.col("proba"), F.col("ids"), 3).alias("proba"))
    own = metrics.renormalised(F.col("proba"))
    return full.select("c_custkey", *[own["proba"][k].alias(f"p{k}") for k in range(3)], own["proba_renormalised"].alias("proba_renormalised"))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_quantity > 48 THEN 0e0 ELSE l_discount END AS a, CASE WHEN l_quantity > 48 THEN 0e0 WHEN l_quantity > 25 THEN 1 - l_discount ELSE l_tax END AS b FROM lineitem)
SELECT row_id, round(CASE WHEN abs(a + b - 1) > 1e-9 THEN a / CASE WHEN a + b = 0 THEN 1 ELSE a + b END ELSE a END, 9) AS p0, round(abs(a + b - 1), 9) AS proba_max_sum_deviation, abs(a + b - 1) > 1e-9 AS proba_renormalised FROM r""")
def probability_renormalise(spark, sf_dir):
    q = F.col("l_quantity")
    r = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.array(F.when(q > 48, 0.0).otherwise(F.col("l_discount").cast("double")), F.when(q > 48, 0.0).when(q > 25, 1 - F.col("l_discount")).otherwise(F.col("l_tax")).cast("double")).alias("proba"))
    own = metrics.renormalised(F.col("proba"))
    return r.select("row_id", F.round(own["proba"][0], 9).alias("p0"), F.round(own["proba_max_sum_deviation"], 9).alias("proba_max_sum_deviation"), own["proba_renormalised"].alias("proba_renormalised"))


@query(f"WITH {_FOLD}, k AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS y FROM (SELECT DISTINCT o_orderstatus AS c FROM f WHERE fold = 'train')) SELECT o_orderkey, y FROM f JOIN k ON k.c = o_orderstatus")
def label_encode(spark, sf_dir):
    return preprocess.labels(_folded(spark, sf_dir), "o_orderstatus").select("o_orderkey", "y")


@query("SELECT name, kind, place FROM (VALUES ('o_custkey', 'numeric', 0), ('o_totalprice', 'numeric', 1), ('o_orderstatus', 'categorical', 2), ('o_orderpriority', 'categorical', 3)) t(name, kind, place)")
def column_index(spark, sf_dir):
    return preprocess.columns(table(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])


@query(f"WITH {_FOLD}, k AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k FROM (SELECT DISTINCT o_orderpriority AS c FROM f WHERE fold = 'train')) SELECT o_orderkey, CAST(k AS VARCHAR) AS o_orderpriority FROM f JOIN k ON k.c = o_orderpriority")
def native_categories(spark, sf_dir):
    return preprocess.native_categories(_folded(spark, sf_dir), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")
