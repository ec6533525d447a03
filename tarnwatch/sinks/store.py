"""The findings store and the audit log, as partitioned files that are only appended to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_scans(scans: DataFrame, findings: DataFrame, path: str) -> None:
    """Appends scans and findings, by month of the scan; a finding's title stands in where it has no description.

    Rows are range-sorted by day first, so that a task writes a few months and not a file in each of them."""
    dated = lambda df: df.withColumn("scan_month", F.date_format("scan_date", "yyyy-MM")).repartitionByRange("scan_date", "scan_id")
    day = scans.select("scan_id", F.to_date("scanned_at").alias("scan_date"))
    dated(scans.withColumn("scan_date", F.to_date("scanned_at"))).write.mode("append").partitionBy("scan_month").parquet(f"{path}/scans")
    f = findings.withColumn("description", F.coalesce("title", "description")).join(day, "scan_id")
    dated(f).write.mode("append").partitionBy("scan_month").parquet(f"{path}/findings")


def recent(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.parquet(f"{path}/scans").orderBy(F.col("scanned_at").desc(), "scan_id").limit(n)


def findings_of(spark: SparkSession, path: str, scan_ids: list[int]) -> DataFrame:
    return spark.read.parquet(f"{path}/findings").where(F.col("scan_id").isin(scan_ids))


def audit(runs: DataFrame, path: str) -> None:
    """One JSON line per run: timestamp, command, package, version, risk score, findings, exit code."""
    runs.select("timestamp", "command", "package", "version", "riskScore", "findingsCount", "exitCode").write.mode("append").json(path)
