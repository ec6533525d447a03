"""Risk scores, counts and rankings over scans and their findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions import severity as S


def package_risk(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Per package of the completed scans: findings, severe findings, their ids, last scan.

    findings are summed per scan before the join, so the join carries one row per scan. Rows that repeat a finding_id
    count once: they are put together by scan and id, in the exchange that the sums need."""
    severe = F.max(F.col("severity").isin("high", "critical").cast("int"))
    once = findings.groupBy("scan_id", "finding_id").agg(severe.alias("severe"), F.collect_set("atk_id").alias("ids"))
    per_scan = once.groupBy("scan_id").agg(F.count("finding_id").alias("n"), F.sum("severe").alias("severe"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    return (
        scans.where("status = 'completed'")
        .join(per_scan, "scan_id", "left")
        .groupBy("package")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("finding_count"),
            F.coalesce(F.sum("severe"), F.lit(0)).alias("severe_count"),
            F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))).alias("atk_ids"),
            F.max("scanned_at").alias("last_scanned"),
        )
    )


def risk_score_sum(findings: DataFrame) -> DataFrame:
    """Summed severity weights over distinct packages of a scan, less the provenance share, at most 10."""
    weight = S.lookup(F.col("severity"), S.SUM_WEIGHT, 0.0)
    a = findings.groupBy("scan_id").agg(
        F.sum(weight).alias("w"),
        F.countDistinct("package").alias("packages"),
        F.max(F.when(F.col("provenance_verified"), F.coalesce(F.col("slsa_level"), F.lit(0)))).alias("slsa"),
    )
    raw = F.col("w") / F.greatest(F.col("packages"), F.lit(1))
    share = F.when(F.col("slsa").isNull(), 0.0).otherwise(F.least(F.lit(0.25), F.col("slsa") * 0.08))
    return a.select("scan_id", F.round(F.least(F.lit(10.0), raw * (1 - share)), 4).alias("risk_score"))


def risk_score_max(findings: DataFrame) -> DataFrame:
    """The lockfile formula: the worst weight plus up to 3 for the number of findings, at most 10."""
    a = findings.groupBy("scan_id").agg(
        F.max(S.lookup(F.col("severity"), S.MAX_WEIGHT, 0.0)).alias("w"), F.count("*").alias("n")
    )
    return a.select(
        "scan_id", F.round(F.least(F.lit(10.0), F.col("w") + F.least(F.col("n") * 0.3, F.lit(3.0))), 4).alias("risk_score")
    )


def worst_severity(findings: DataFrame) -> DataFrame:
    a = findings.groupBy("scan_id").agg(F.max(S.rank(F.col("severity"))).alias("severity_rank"))
    return a.withColumn("worst", S.from_rank(F.col("severity_rank")))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Per severity: scans that have it at least once, and its findings."""
    return findings.groupBy("severity").agg(
        F.countDistinct("scan_id").alias("scans"), F.count("*").alias("findings")
    )


def severity_gate(findings: DataFrame, level: str) -> DataFrame:
    """Per scan whether any finding reaches the level, and the exit code that gives."""
    hit = F.max((S.rank(F.col("severity")) >= S.RANK[level]).cast("int"))
    return findings.groupBy("scan_id").agg(hit.alias("exit_code"))


def recent_scans(scans: DataFrame, n: int) -> DataFrame:
    return scans.orderBy(F.col("scanned_at").desc(), F.col("scan_id")).limit(n)


def top_findings(findings: DataFrame, weight: str, k: int = 5) -> DataFrame:
    w = Window.partitionBy("package").orderBy(F.col(weight).desc(), F.col("finding_id"))
    return findings.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
