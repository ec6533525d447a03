"""Detection rates, precision and false positives over labelled scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def campaign_rates(scans: DataFrame) -> DataFrame:
    """scans: campaign, expected and detected (arrays). Scans with any expected hit, and expected hits matched."""
    matched = F.size(F.array_intersect("expected", "detected"))
    a = scans.groupBy("campaign").agg(
        F.count("*").alias("total"),
        F.count_if(matched > 0).alias("hit"),
        F.sum(F.size("expected")).alias("expected"),
        F.sum(matched).alias("matched"),
    )
    return a.select("*", F.round(F.col("hit") / F.col("total"), 4).alias("detection_rate"), F.round(F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(0.0), 4).alias("match_rate"))


def precision_by_detector(hits: DataFrame) -> DataFrame:
    """hits: detector, confidence (null: none, left out of the average), expected (boolean)."""
    a = hits.groupBy("detector").agg(F.count("*").alias("hits"), F.count_if("expected").alias("expected_hits"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    return a.withColumn("precision", F.round(F.col("expected_hits") / F.col("hits"), 4))


def detection_matrix(hits: DataFrame) -> DataFrame:
    return hits.groupBy("campaign", "detector").agg(F.count("*").alias("n"))


def false_positives(hits: DataFrame, whitelist: DataFrame, threshold: float = 70, many: int = 5) -> DataFrame:
    """Per detector: findings at the threshold or without a score, off the white list; their share and spread."""
    kept = hits.where((F.col("confidence") >= threshold) | F.col("confidence").isNull()).join(whitelist, ["package", "detector"], "left_anti")
    a = kept.groupBy("detector").agg(
        F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.countDistinct("package").alias("packages"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")],
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return a.withColumn("share", F.round(share, 4)).withColumn("high_fp", F.col("n") >= many)


def examples(hits: DataFrame, k: int = 5) -> DataFrame:
    """The first k findings of each detector."""
    w = Window.partitionBy("detector").orderBy("finding_id")
    return hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def corpus_rates(scans: DataFrame) -> DataFrame:
    """scans: clean (boolean), findings: share of clean scans with findings and of others without."""
    hit = F.col("findings") > 0
    return scans.agg(
        F.round(F.avg(F.when(F.col("clean"), hit.cast("double"))), 4).alias("fp_rate"),
        F.round(F.avg(F.when(~F.col("clean"), hit.cast("double"))), 4).alias("detection_rate"),
    )
