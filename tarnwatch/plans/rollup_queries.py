"""Roll-ups over the stand-in scans and findings."""

from __future__ import annotations

from tarnwatch.operators import rollups as R
from tarnwatch.plans.standins import WITH, findings, scans

QUERIES = {
    "package_risk": lambda s, d: R.package_risk(scans(s, d), findings(s, d)),
    "risk_score_sum": lambda s, d: R.risk_score_sum(findings(s, d)),
    "risk_score_max": lambda s, d: R.risk_score_max(findings(s, d)),
    "worst_severity": lambda s, d: R.worst_severity(findings(s, d)),
    "severity_counts": lambda s, d: R.severity_counts(findings(s, d)),
    "severity_gate": lambda s, d: R.severity_gate(findings(s, d), "high"),
    "recent_scans_topk": lambda s, d: R.recent_scans(scans(s, d), 10),
    "top_findings": lambda s, d: R.top_findings(findings(s, d), "weight").select(
        "package", "finding_id", "weight", "position"
    ),
}

_SUM = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 3 WHEN 'high' THEN 7 WHEN 'critical' THEN 10 ELSE 0 END"
_MAX = "CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 WHEN 'info' THEN 0.5 ELSE 0 END"
_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"

ORACLE = {
    "package_risk": WITH
    + """SELECT s.package, count(DISTINCT f.finding_id) AS finding_count,
  count(DISTINCT f.finding_id) FILTER (WHERE f.severity IN ('high', 'critical')) AS severe_count,
  coalesce(array_to_string(list_sort(list_distinct(list(f.atk_id))), ','), '') AS atk_ids, max(s.scanned_at) AS last_scanned
FROM scans s LEFT JOIN findings f USING (scan_id) WHERE s.status = 'completed' GROUP BY s.package""",
    "risk_score_sum": WITH
    + f"""SELECT scan_id, round(least(10.0, w / packages * (1 - CASE WHEN slsa IS NULL THEN 0.0 ELSE least(0.25, slsa * CAST(0.08 AS DOUBLE)) END)), 4) AS risk_score
FROM (SELECT scan_id, CAST(sum({_SUM}) AS DOUBLE) AS w, count(DISTINCT package) AS packages, max(CASE WHEN provenance_verified THEN slsa_level END) AS slsa FROM findings GROUP BY scan_id)""",
    "risk_score_max": WITH
    + f"""SELECT scan_id, round(CAST(least(10.0, max({_MAX}) + least(count(*) * 0.3, 3.0)) AS DOUBLE), 4) AS risk_score FROM findings GROUP BY scan_id""",
    "worst_severity": WITH
    + f"""SELECT scan_id, max({_RANK}) AS severity_rank, arg_max(severity, {_RANK}) AS worst FROM findings GROUP BY scan_id""",
    "severity_counts": WITH
    + "SELECT severity, count(DISTINCT scan_id) AS scans, count(*) AS findings FROM findings GROUP BY severity",
    "severity_gate": WITH
    + "SELECT scan_id, CAST(bool_or(severity IN ('high', 'critical')) AS INT) AS exit_code FROM findings GROUP BY scan_id",
    "recent_scans_topk": WITH + "SELECT * FROM scans ORDER BY scanned_at DESC, scan_id LIMIT 10",
    "top_findings": WITH
    + """SELECT package, finding_id, weight, position FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY weight DESC, finding_id) AS position FROM findings) WHERE position <= 5""",
}
