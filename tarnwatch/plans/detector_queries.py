"""Detectors over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.functions import signal_catalog as K
from tarnwatch.operators import detectors as D
from tarnwatch.operators import registry as G
from tarnwatch.operators import rules as R
from tarnwatch.operators import windows as W
from tarnwatch.sources.tables import table


def _campaign(s, d):
    """Line items as rule hits: the return flag is the rule, the order the package."""
    l = table(s, d, "lineitem")
    sev = F.when(F.col("l_quantity") > 45, "critical").when(F.col("l_quantity") > 25, "high").otherwise("medium")
    hits = l.select(F.col("l_orderkey").alias("package"), F.col("l_linestatus").alias("version"), F.col("l_returnflag").alias("rule"), sev.alias("severity"))
    return R.campaign(hits, "R").select("package", "version", F.concat_ws(",", "rules").alias("rules"), "severity")


def _siblings(s, d):
    """Users stand in for packages; those of equal remainder share a scope."""
    e = table(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("from"), F.max("ts").alias("until"))
    name = F.concat(F.lit("@s"), (F.col("user_id") % 9).cast("string"), F.lit("/p"), F.col("user_id").cast("string"))
    return G.sibling_overlap(e.select(name.alias("package"), "from", "until"))


def _blocked(s, d):
    own = table(s, d, "customer").select(F.col("c_nationkey").alias("package"), F.col("c_mktsegment").alias("version"), "c_custkey")
    bad = table(s, d, "supplier").select(F.col("s_nationkey").alias("package"), F.when(F.col("s_acctbal") > 5000, "BUILDING").otherwise("MACHINERY").alias("version"))
    return G.blocklisted(own, bad)


def _surfaces(s, d):
    from tarnwatch.operators.code_facts import surface_band

    folder = F.element_at(F.array(*[F.lit(x) for x in (".claude/settings.json", ".cursor/rules/a.md", ".vscode/x.json", "src/a.js", "AGENTS.md")]), (F.col("p_size") % 5 + 1).cast("int"))
    return table(s, d, "part").select("p_partkey", surface_band(folder).alias("band")).where("band IS NOT NULL")


QUERIES = {
    "sibling_overlap": _siblings,
    "version_blocklist": _blocked,
    "quick_handover": lambda s, d: G.quick_handover(table(s, d, "events"), "user_id", "ts", "event_type", 15 * W.MINUTE),
    "surface_band": _surfaces,
    "campaign_rollup": _campaign,
    "signal_weighted_docs": lambda s, d: D.weighted(table(s, d, "documents"), "PLAIN", K.PLAIN, "doc_id", "text").select("doc_id", "score", "severity", "raw_score"),
    "version_confusion": lambda s, d: D.version_confusion(
        table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(".", F.floor("l_quantity").cast("string"), (F.col("l_partkey") % 12).cast("string"), F.col("l_linenumber").cast("string")).alias("version"))
    ),
}

ORACLE = {
    "sibling_overlap": """SELECT scope, max(lo) AS "from", min(hi) AS until, count(*) AS packages FROM (SELECT '@s' || CAST(user_id % 9 AS VARCHAR) AS scope, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY user_id, user_id % 9)
GROUP BY scope HAVING count(*) >= 2 AND max(lo) < min(hi)""",
    "version_blocklist": """SELECT c_nationkey AS package, c_mktsegment AS version, c_custkey FROM customer c WHERE EXISTS (
  SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND CASE WHEN s.s_acctbal > 5000 THEN 'BUILDING' ELSE 'MACHINERY' END = c.c_mktsegment)""",
    "quick_handover": """SELECT user_id, ts AS at, before, event_type AS after FROM (SELECT *, lag(event_type) OVER o AS before, epoch_us(ts) - lag(epoch_us(ts)) OVER o AS gap
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_type)) WHERE before <> event_type AND gap <= 900000000""",
    "surface_band": """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'exec' WHEN 1 THEN 'agent_read' WHEN 2 THEN 'editor_config' WHEN 4 THEN 'agent_read' END AS band FROM part WHERE p_size % 5 <> 3""",
    "campaign_rollup": """WITH h AS (SELECT l_orderkey AS package, l_linestatus AS version, l_returnflag AS rule, CASE WHEN l_quantity > 45 THEN 5 WHEN l_quantity > 25 THEN 4 ELSE 3 END AS r FROM lineitem),
x AS (SELECT *, bool_or(rule = 'R') OVER (PARTITION BY package, version) AS halted FROM h)
SELECT package, version, array_to_string(list_sort(list_distinct(list(rule))), ',') AS rules, CASE max(r) WHEN 5 THEN 'critical' WHEN 4 THEN 'high' ELSE 'medium' END AS severity
FROM x WHERE NOT halted OR rule = 'R' GROUP BY package, version""",
    "signal_weighted_docs": """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[0-9a-f]{40}')) * 60 + len(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) * 20
  + len(regexp_extract_all(text, 'AKIA[A-Z0-9]{16}')) * 55 + len(regexp_extract_all(text, '(?i)(token|secret|password|api_key)')) * 15 AS raw FROM documents)
SELECT doc_id, CAST(sum(raw) AS INT) AS raw_score, CAST(least(sum(raw), 100) AS INT) AS score,
  CASE WHEN least(sum(raw), 100) >= 75 THEN 'critical' WHEN least(sum(raw), 100) >= 55 THEN 'high' WHEN sum(raw) >= 30 THEN 'medium' ELSE 'low' END AS severity
FROM c WHERE raw > 0 GROUP BY doc_id""",
    "version_confusion": """SELECT * FROM (SELECT l_orderkey, l_linenumber, version, CASE WHEN version = '99.99.99' THEN 85 WHEN version IN ('9.9.9', '9.9.10', '10.10.10', '11.11.11') THEN 65 WHEN a >= 9 AND b >= 5 AND c >= 5 THEN 62 END AS score
FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS INT) AS a, l_partkey % 12 AS b, l_linenumber AS c,
  CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR) || '.' || CAST(l_partkey % 12 AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) AS version FROM lineitem)) WHERE score IS NOT NULL""",
}
