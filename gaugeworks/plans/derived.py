"""Evaluation tables derived from the test tables, by SQL that Spark and DuckDB both read.

Double literals are written with an exponent, so that neither engine computes them as decimals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.session import table

#: Binary predictions: 7 models x 25 datasets x 5 seeds.
PRED_BIN = """
SELECT concat('m', CAST(l_linenumber AS STRING)) AS model, p_brand AS dataset, CAST(l_orderkey % 5 AS INT) AS seed, l_orderkey * 10 + l_linenumber AS row_id,
  CASE WHEN l_discount > 0.05e0 THEN 1 ELSE 0 END AS y,
  0.02e0 + 0.9e0 * (l_quantity / 51e0 * 0.45e0 + l_tax * 3.5e0 + (CASE WHEN l_discount > 0.05e0 THEN 0.04e0 ELSE 0e0 END) * CAST(l_linenumber AS DOUBLE) + CAST((l_partkey + l_linenumber) % 7 AS DOUBLE) * 0.01e0) AS score
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

#: Regression predictions on the same grid; even models give no sigma.
PRED_REG = """
SELECT concat('m', CAST(l_linenumber AS STRING)) AS model, p_brand AS dataset, CAST(l_orderkey % 5 AS INT) AS seed, l_orderkey * 10 + l_linenumber AS row_id,
  l_extendedprice AS y, l_quantity * (1400e0 + 25e0 * CAST(l_linenumber AS DOUBLE)) + l_tax * 10000e0 AS pred,
  CASE WHEN l_linenumber % 2 = 1 THEN 1000e0 + 100000e0 * l_tax END AS sigma
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

#: Multi-class predictions: 3 models x 2 seeds, 10 classes.
PRED_MULTI = """
SELECT concat('m', CAST(vec_id % 3 AS STRING)) AS model, CAST(vec_id % 2 AS INT) AS seed, vec_id AS row_id, label AS y, embedding AS raw FROM {embeddings}
"""

#: Declared and executed cells: status by the order's, leg by its priority.
CELLS = """
SELECT concat('f', CAST(o_custkey % 3 AS INT), ':d', CAST(o_custkey % 20 AS INT)) AS dataset, CASE WHEN o_orderkey % 3 = 0 THEN 'cv' ELSE 'hpo' END AS protocol,
  concat('m', CAST(o_orderkey % 7 AS INT)) AS model, CAST(o_orderkey % 5 AS INT) AS seed, o_orderpriority AS leg,
  CASE WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'error:Timeout' ELSE 'ok' END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'skipped_feature_cap' ELSE 'skipped_missing_backend:x' END END AS status,
  o_orderkey AS row_id
FROM {orders}
"""

#: Environment stamps of cells.
ENV = """
SELECT event_id, concat('host', CAST(user_id % 3 AS INT)) AS host, event_type AS code_sha256, CASE WHEN user_id % 11 = 0 THEN NULL ELSE concat('prefix', CAST(user_id % 2 AS INT)) END AS prefix FROM {events}
"""


def duck(sql: str) -> str:
    """The text for DuckDB, where the tables have their own names."""
    return sql.format(**{t: t for t in ("lineitem", "part", "orders", "embeddings", "events", "customer", "supplier", "nation", "region", "documents", "labels")})


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in ("lineitem", "part", "orders", "embeddings", "events", "customer", "supplier", "nation", "region", "documents", "labels") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})
