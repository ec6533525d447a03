"""A policy document as three small tables: allowed packages, suppressions, overrides; and the failing level."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.functions import text as T

LEVELS = ("none", "low", "medium", "high", "critical")
CONTEXT = ("is_dist_build", "is_test_fixture", "is_lifecycle_hook", "is_known_safe_domain", "provenance_verified")
SUPPRESS = "atk_id string, package string, reason string, reputation_tier string, path_regex string, url_domain string, " + ", ".join(f"{c} boolean" for c in CONTEXT)


class Policy(NamedTuple):
    allow: DataFrame
    suppress: DataFrame
    overrides: DataFrame
    fail_on: str


def load(spark: SparkSession, text: str, kind: str = "yaml") -> Policy:
    """The document, checked: unknown severities and suppressions without an id are errors."""
    if kind == "json":
        doc = json.loads(text)
    else:
        import yaml

        doc = yaml.safe_load(text)
    if not isinstance(doc, dict):
        raise ValueError("a policy is an object")
    overrides, level, rules = doc.get("severity_overrides") or {}, doc.get("fail_on") or "none", doc.get("suppress") or []
    packages = (doc.get("allow") or {}).get("packages") or []
    if bad := [s for s in [*overrides.values(), level] if s not in LEVELS]:
        raise ValueError(f"unknown severity {bad[0]}")
    if not isinstance(rules, list) or not isinstance(packages, list):
        raise ValueError("suppress and allow.packages are lists")
    if any(not isinstance(r, dict) or not r.get("atk_id") for r in rules):
        raise ValueError("a suppression names an atk_id")
    rows = []
    for r in rules:
        c = r.get("context") or {}
        path = c.get("file_path")
        rows.append((r["atk_id"], r.get("package") or "*", r.get("reason") or "", r.get("reputation_tier"), T.glob(path) if path and path != "*" else None, c.get("url_domain"), *[c.get(x) for x in CONTEXT]))
    return Policy(
        spark.createDataFrame([(p,) for p in packages], "entry string"), spark.createDataFrame(rows, SUPPRESS),
        spark.createDataFrame(list(overrides.items()), "atk_id string, severity string"), level,
    )


def tier(package, reputable: list[str]):
    """trusted for a name, or the scope before the slash, on the list; else unknown."""
    name = F.regexp_replace(F.regexp_replace(package, "^@", ""), "/.*", "")
    return F.when(name.isin(*reputable), "trusted").otherwise("unknown")
