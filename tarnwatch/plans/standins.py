"""Driver tables seen as scans, findings and versions: the tables have no packages of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.sources.tables import table

SEVERITY_SQL = (
    "CASE WHEN l_discount >= 0.09 THEN 'critical' WHEN l_discount >= 0.07 THEN 'high' "
    "WHEN l_discount >= 0.05 THEN 'medium' WHEN l_discount >= 0.03 THEN 'low' ELSE 'info' END"
)

#: The same two views for the oracle.
WITH = f"""WITH scans AS (SELECT o_orderkey AS scan_id, o_custkey AS package,
  CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS scanned_at FROM orders),
findings AS (SELECT l_orderkey AS scan_id, l_partkey AS package, l_orderkey * 10 + l_linenumber AS finding_id,
  'ATK-' || lpad(CAST(l_suppkey % 11 + 1 AS VARCHAR), 3, '0') AS atk_id, {SEVERITY_SQL} AS severity,
  l_returnflag = 'A' AS provenance_verified, l_linenumber % 4 AS slsa_level,
  l_extendedprice AS weight, CAST(floor(l_quantity * 2) AS INT) AS confidence_score FROM lineitem)
"""


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan_id"),
        F.col("o_custkey").alias("package"),
        F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"),
        F.col("o_orderdate").alias("scanned_at"),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"),
        F.col("l_partkey").alias("package"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("finding_id"),
        F.concat(F.lit("ATK-"), F.lpad((F.col("l_suppkey") % 11 + 1).cast("string"), 3, "0")).alias("atk_id"),
        F.expr(SEVERITY_SQL).alias("severity"),
        (F.col("l_returnflag") == "A").alias("provenance_verified"),
        (F.col("l_linenumber") % 4).alias("slsa_level"),
        F.col("l_extendedprice").alias("weight"),
        F.floor(F.col("l_quantity") * 2).cast("int").alias("confidence_score"),
    )
