"""The job side over the test tables: tokens, checks of declared against shipped, cells executed one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.scalars import unit
from gaugeworks.operators import jobs
from gaugeworks.session import stored, table
from gaugeworks.sources import records

from .derived import CELLS, derived, duck

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
C = duck(CELLS)
#: Brands as members: declared kind by the least part's number, effective kind by the most frequent container's size.
_MEMBERS = "mb AS (SELECT p_brand AS member, CASE WHEN min(p_partkey) % 3 = 0 THEN 'regression' WHEN min(p_partkey) % 3 = 1 THEN 'binclass' ELSE 'multiclass' END AS declared, CASE WHEN max(p_partkey) % 2 = 0 THEN 'regression' ELSE 'binclass' END AS effective FROM part GROUP BY p_brand)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _members(spark, sf_dir):
    low, high = F.min("p_partkey") % 3, F.max("p_partkey") % 2
    kind = F.when(low == 0, "regression").when(low == 1, "binclass").otherwise("multiclass")
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("member")).agg(kind.alias("declared"), F.when(high == 0, "regression").otherwise("binclass").alias("effective"))


def _kinds(spark, sf_dir, which: str):
    return _members(spark, sf_dir).select("member", F.col(which).alias("kind"))


@query(f"WITH {_MEMBERS} SELECT * FROM mb WHERE declared <> effective")
def type_mismatch(spark, sf_dir):
    return jobs.mismatch(_kinds(spark, sf_dir, "declared"), _kinds(spark, sf_dir, "effective"))


@query(f"WITH {_MEMBERS} SELECT declared AS kind, count(*) AS n FROM mb GROUP BY declared")
def type_tallies(spark, sf_dir):
    return jobs.tallies(_kinds(spark, sf_dir, "declared"))


@query("""WITH a AS (SELECT DISTINCT c_nationkey AS task_id, c_custkey % 40 AS dataset_id FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT DISTINCT c_nationkey AS task_id, c_custkey % 40 AS dataset_id FROM customer WHERE c_custkey % 3 <> 1)
SELECT *, 'live' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'frozen' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def snapshot_drift(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("task_id"), (F.col("c_custkey") % 40).alias("dataset_id"), "c_custkey")
    return jobs.drift(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 3 <> 1"), ["task_id", "dataset_id"])


@query("SELECT DISTINCT p_brand AS member FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 7 = 0 AND p_size > 40)")
def missing_members(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("member"), "p_partkey", "p_size")
    return jobs.absent(p, p.where("p_partkey % 7 = 0 and p_size > 40"))


@query("""WITH m AS (SELECT DISTINCT o_orderpriority AS member FROM orders), s AS (SELECT o_orderpriority AS member, count(DISTINCT CASE WHEN o_orderpriority < '3' THEN CAST(o_orderkey % 2 AS INT) ELSE CAST(o_orderkey % 5 AS INT) END) AS distinct_y FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
o AS (SELECT member, CASE WHEN member LIKE '4%' THEN 'regression' ELSE 'binclass' END AS override FROM m) SELECT member, override, CASE WHEN distinct_y IS NOT NULL THEN 'int' END AS dtype, distinct_y, override = 'binclass' AND distinct_y IS DISTINCT FROM 2 AS not_binary FROM o LEFT JOIN s USING (member)""")
def override_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("member"), F.when(F.col("o_orderpriority") < "3", F.col("o_orderkey") % 2).otherwise(F.col("o_orderkey") % 5).cast("int").alias("y"))
    overrides = o.select("member").distinct().withColumn("kind", F.when(F.startswith("member", F.lit("4")), "regression").otherwise("binclass"))
    return jobs.label_check(o.where("member <> '5-LOW'"), overrides)


@query("SELECT p_type AS stratum, count_if(p_partkey % 5 = 0) AS selected, count(*) AS total FROM part GROUP BY p_type")
def stratum_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("stratum"), "p_partkey")
    return jobs.stratum_coverage(p, p.where("p_partkey % 5 = 0"), "stratum", "p_partkey")


@query("SELECT count(*) AS n_claims, count_if(c_acctbal > 0) AS n_survived, count_if(c_acctbal > 0) / CAST(count(*) AS DOUBLE) AS survival_rate FROM customer")
def survival_rate(spark, sf_dir):
    return jobs.survival_rate(table(spark, sf_dir, "customer").select((F.col("c_acctbal") > 0).alias("survives")))


@query(f"WITH c AS ({C}) SELECT array_to_string(list_sort(list(DISTINCT split_part(dataset, ':', 1))), ',') AS families, array_to_string(list_sort(list(DISTINCT protocol)), ',') AS protocols FROM c")
def axes_present(spark, sf_dir):
    c = derived(spark, sf_dir, CELLS).withColumn("family", F.split_part("dataset", F.lit(":"), F.lit(1)))
    return jobs.axes_present(c).select(*[F.array_join(k, ",").alias(k) for k in ("families", "protocols")])


@query("SELECT n_nationkey, n_name AS member, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS external_name FROM nation")
def external_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    aliases = n.where("n_regionkey = 1").select(F.col("n_name").alias("member"), F.lower("n_name").alias("external_name"))
    return jobs.renamed(n.select("n_nationkey", F.col("n_name").alias("member")), aliases).select("n_nationkey", "member", "external_name")


@query("SELECT count(*) AS n, count_if(s_suppkey % 4 > 0) AS n_ok, count_if(s_suppkey % 4 = 0) AS n_missing FROM supplier")
def unresolved_ids(spark, sf_dir):
    return jobs.unresolved(table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 4 == 0, "missing_VERIFY").otherwise("ok").alias("status")))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 7 WHEN vec_id % 3 = 1 THEN len(embedding) ELSE 2 END AS n_train FROM embeddings")
def train_sizes(spark, sf_dir):
    third = F.col("vec_id") % 3
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(third == 0, 7).alias("told"), F.when(third == 1, F.col("embedding")).alias("y"), F.array(F.lit("a"), F.lit("b")).alias("cat"))
    return e.select("vec_id", jobs.train_size(F.col("told"), F.col("y"), F.col("cat")).alias("n_train"))


@query("""WITH l AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'fit\nReducing max_samples_support from 5000 to 2500\nReducing max_samples_support from  2500 to 1250\ndone' WHEN 1 THEN 'fit done' END AS log FROM customer)
SELECT c_custkey, log LIKE '%Reducing%' AND log IS NOT NULL AS context_reduced, CASE WHEN log LIKE '%Reducing%' THEN 5000 END AS context_from, CASE WHEN log LIKE '%Reducing%' THEN 1250 END AS context_to, CASE WHEN log LIKE '%Reducing%' THEN 2 ELSE 0 END AS context_reduction_steps FROM l""")
def context_reductions(spark, sf_dir):
    k = F.col("c_custkey") % 3
    log = F.when(k == 0, "fit\nReducing max_samples_support from 5000 to 2500\nReducing max_samples_support from  2500 to 1250\ndone").when(k == 1, "fit done")
    return jobs.context_reductions(table(spark, sf_dir, "customer").select("c_custkey", log.alias("log")), "log").drop("log")


@query("SELECT place, 'core:' || member AS dataset FROM (SELECT row_number() OVER (ORDER BY p_brand) - 1 AS place, p_brand AS member FROM (SELECT DISTINCT p_brand FROM part)) WHERE place < 12")
def family_tokens(spark, sf_dir):
    """A frozen suite of brands under another family's name, cut to its first twelve."""
    names = sorted(r[0] for r in table(spark, sf_dir, "part").select("p_brand").distinct().collect())
    members = spark.createDataFrame(list(enumerate(names)), "place long, member string")
    return jobs.expand("core_subset", {"emit_as": "core", "resolve": "static_snapshot", "max_datasets": 12}, members)


@query(f"""WITH c AS ({C}), u AS (SELECT dataset || '__' || protocol || '__' || model || '__seed' || seed AS unit, model, seed, count(*) AS n, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS cents, CAST(round((max(o_totalprice) - min(o_totalprice)) * 100) AS BIGINT) AS range FROM c JOIN orders ON row_id = o_orderkey GROUP BY ALL)
SELECT unit, CASE WHEN seed = 4 THEN 'error:ValueError' WHEN model = 'm3' THEN 'skipped_class_cap' ELSE 'ok' END AS status, CASE WHEN seed = 4 THEN concat('seed 4 of ', n, ' rows') END AS msg,
  CASE WHEN seed <> 4 AND model <> 'm3' THEN cents END AS cents, CASE WHEN seed <> 4 AND model <> 'm3' THEN range END AS range FROM u""")
def cell_execution(spark, sf_dir):
    """Every declared cell is run on its own rows, in a process of its own: one seed raises, one system is skipped, the rest go on."""
    c = derived(spark, sf_dir, CELLS).select("dataset", "protocol", "model", "seed", F.col("row_id").alias("o_orderkey")).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    c = c.groupBy("dataset", "protocol", "model", "seed").agg(F.collect_list("o_totalprice").alias("y"))
    c = c.withColumn("unit", unit(F.col("dataset"), F.col("protocol"), F.col("model"), F.col("seed")))

    def work(cell: dict) -> dict:
        y = cell["y"]
        if cell["seed"] == 4:
            raise ValueError(f"seed 4 of {len(y)} rows")
        if cell["model"] == "m3":
            return {"status": "skipped_class_cap"}
        return {"cents": round(float(y.sum()) * 100), "range": round(float(y.max() - y.min()) * 100)}

    told = lambda k, t: F.get_json_object("record", f"$.{k}").cast(t).alias(k)
    return jobs.execute(spark, c, work, timeout_s=30).select("unit", "status", told("msg", "string"), told("cents", "long"), told("range", "long"))


@query(f"WITH c AS ({C}) SELECT count(*) AS n_cells, count_if(status = 'ok') AS n_ok, count_if(status LIKE 'error:%') AS n_error, count(DISTINCT dataset) AS n_datasets FROM c")
def observed_counts(spark, sf_dir):
    """Headline counts told by the scan that stores the cells, without a second one."""
    c = derived(spark, sf_dir, CELLS)
    seen = records.Counted(n_cells=F.count(F.lit(1)), n_ok=F.count_if(F.col("status") == "ok"), n_error=F.count_if(F.startswith("status", F.lit("error:"))), datasets=F.collect_set("dataset"))
    told = seen.after(stored(seen.of(c), "cells"))
    return spark.createDataFrame([(told["n_cells"], told["n_ok"], told["n_error"], len(told["datasets"]))], "n_cells long, n_ok long, n_error long, n_datasets long")


@query("SELECT concat('worker', user_id % 4) AS host, count(*) AS n FROM events GROUP BY ALL")
def stamped_workers(spark, sf_dir):
    """Events dealt to four workers by name: the count of each that a stamp of every slot is joined to."""
    slots = jobs.worker_stamps(spark, slots=1).select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), F.col("code_sha256").isNotNull().alias("stamped"))
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 4).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return e.join(slots.where("stamped"), "k").select(F.concat(F.lit("worker"), "k").alias("host"), "n")
