"""Suppression, overrides, allow lists and the failing level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions import severity as S
from tarnwatch.functions import text as T
from tarnwatch.operators.iocs import sized


def allowed(packages: DataFrame, allow: DataFrame) -> DataFrame:
    """Packages not on the allow list, by name or name@version; a name is cut at its last @ beyond the first place."""
    full = packages.withColumn("__full", F.concat_ws("@", "package", "version"))
    a = sized(allow.select(F.col("entry").alias("__e")).distinct())
    return full.join(a, F.col("__full") == F.col("__e"), "left_anti").join(a, F.col("package") == F.col("__e"), "left_anti").drop("__full")


_ASKED = ("is_dist_build", "is_test_fixture", "is_known_safe_domain", "provenance_verified")


def suppress(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings without those a rule names: same id, package equal or *, and every condition the rule sets.

    Findings of lifecycle hooks and of several layers always stay. Rules: atk_id, package, path_regex, url_domain (*
    for anything), reputation_tier, and booleans; what is null, or no column of the rules, is not asked for. A finding
    without a domain meets no rule that asks for one."""
    have = [c for c in (*_ASKED, "path_regex", "url_domain", "reputation_tier") if c in rules.columns]
    r = sized(rules.select(*[F.col(c).alias(f"r_{c}") for c in ("atk_id", "package", *have)]))
    hit = (F.col("atk_id") == F.col("r_atk_id")) & ((F.col("r_package") == "*") | (F.col("r_package") == F.col("package").cast("string")))
    for c in have:
        asked = F.col(f"r_{c}")
        if c == "path_regex":
            met = F.regexp_like(F.coalesce("file_path", F.lit("")), asked)
        elif c == "url_domain":
            met = F.coalesce(T.domain_matches(F.col("url_domain"), asked), F.lit(False))
        elif c == "reputation_tier":
            met = asked.isin("*", "any") | (asked == F.col("reputation_tier"))
        else:
            met = asked == F.coalesce(F.col(c), F.lit(False))
        hit = hit & (asked.isNull() | met)
    guarded = F.coalesce("is_lifecycle_hook", F.lit(False)) | F.coalesce("is_multi_layer", F.lit(False))
    return findings.join(r, hit & ~guarded, "left_anti")


def override(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Severity by id where a rule sets one."""
    r = sized(rules.select(F.col("atk_id").alias("__id"), F.col("severity").alias("__s")))
    j = findings.join(r, F.col("atk_id") == F.col("__id"), "left")
    return j.withColumn("severity", F.coalesce("__s", "severity")).drop("__id", "__s")


def fails(findings: DataFrame, level: str) -> DataFrame:
    """Per scan whether its worst finding reaches the level; level none never fails."""
    worst = findings.groupBy("scan_id").agg(F.max(S.rank(F.col("severity"))).alias("worst_rank"))
    return worst.withColumn("blocked", F.lit(level != "none") & (F.col("worst_rank") >= S.RANK[level]))


def hit_rate_guard(findings: DataFrame, files: DataFrame, least_files: int = 10, share: float = 0.8) -> DataFrame:
    """Drops all findings a detector has on a package if it hits more than `share` of ten files or more."""
    hits = findings.groupBy("package", "detector").agg(F.count("*").alias("__h"))
    many = files.groupBy("package").agg(F.count("*").alias("__f"))
    noisy = hits.join(many, "package").where((F.col("__f") >= least_files) & (F.col("__h") > F.col("__f") * share))
    return findings.join(noisy.select("package", "detector"), ["package", "detector"], "left_anti")
