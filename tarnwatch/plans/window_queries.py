"""Publish-time rules over the events table: users stand in for packages, event types for publishers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.operators import windows as W
from tarnwatch.sources.tables import table


def _events(s, d):
    return table(s, d, "events")


def _published(s, d):
    """Events with 65 publishers, made of type and id."""
    return _events(s, d).withColumn("publisher", F.concat("event_type", F.lit("-"), (F.col("event_id") % 13).cast("string")))


def _deprecated(s, d):
    return W.gap_then_fix(_events(s, d), "user_id", "ts", F.col("event_type") == "click", 12 * W.HOUR, 48 * W.HOUR)


def _versions(s, d):
    """event_id spread over three numbers is the version."""
    return _events(s, d).withColumn("ts", F.expr("timestampadd(SECOND, CAST(user_id % 7 * 40000 * (event_id % 10) / 10 AS INT), TIMESTAMP '2024-01-01')"))


def _lines(s, d):
    docs = table(s, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "content"))


def _scores(s, d):
    l = table(s, d, "lineitem")
    score = (F.floor("l_quantity") * 10000 + F.floor(F.col("l_discount") * 100 + F.lit(0.5)) * 100 + F.col("l_linenumber")).cast("long")
    return l.select("l_partkey", score.alias("score"), (F.col("l_linenumber") == 1).alias("current"))


QUERIES = {
    "burst_30m": lambda s, d: W.anchored_burst(_events(s, d), "user_id", "ts", 30 * W.MINUTE, 3),
    "burst_6h": lambda s, d: W.anchored_burst(_events(s, d), "user_id", "ts", 6 * W.HOUR, 3),
    "burst_24h_score": lambda s, d: W.burst_score(_events(s, d), "user_id", "ts", W.DAY, 3),
    "propagation_burst": lambda s, d: W.propagation_score(_events(s, d), "user_id", "ts"),
    "publisher_change_rapid": lambda s, d: W.rapid_publisher_change(_events(s, d), "user_id", "ts", "event_type", 10 * W.MINUTE, 2),
    "hot_pull_gap": lambda s, d: W.hot_pull(_events(s, d), "user_id", "ts"),
    "publisher_drift_last3": lambda s, d: W.publisher_drift(_published(s, d), "user_id", "ts", "publisher", "event_id"),
    "publisher_drift_spike": lambda s, d: W.spike_drift(_published(s, d), "user_id", "ts", "publisher", 6 * W.HOUR),
    "gap_then_fix": _deprecated,
    "tag_repoint": lambda s, d: W.tag_repoint(
        _events(s, d), _events(s, d).where("event_type = 'purchase'").select("user_id", "event_id", F.lit("latest").alias("tag")), "user_id", "event_id", "ts"
    ),
    "backfill_span": lambda s, d: W.backfill_span(_versions(s, d), "user_id", "ts", F.col("event_id") % 3, F.col("event_id") % 5),
    "first_attested": lambda s, d: W.first_attested(_events(s, d), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("user_id", "event_id"),
    "zscore_ladder": lambda s, d: W.zscore_ladder(_scores(s, d), "l_partkey", "score", "current"),
    "line_window": lambda s, d: W.neighbours(_lines(s, d), "doc_id", "line", F.col("content").contains("the "), F.col("content").rlike("[0-9]{2}")),
    "cache_prune": lambda s, d: W.cache_prune(
        table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice", "p_partkey", 20000.0
    ).select("p_partkey", "running", "stays"),
}


def _burst(minutes: int, least: int) -> str:
    return f"""SELECT user_id, min(ts) AS burst_start, arg_min(n, ts) AS versions_in_burst FROM (
  SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL {minutes} MINUTE FOLLOWING) AS n
  FROM events) WHERE n >= {least} GROUP BY user_id"""


_GAP = "(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts{}))"

_PUBLISHED = "WITH e AS (SELECT *, event_type || '-' || CAST(event_id % 13 AS VARCHAR) AS publisher FROM events) "

ORACLE = {
    "burst_30m": _burst(30, 3),
    "burst_6h": _burst(360, 3),
    "propagation_burst": f"SELECT *, 60 + least(versions_in_burst * 5, 25) AS score FROM ({_burst(60, 3)})",
    "burst_24h_score": """SELECT user_id, burst_start, n, night, score FROM (SELECT user_id, ts AS burst_start, n, night,
  round(least(40.0 + CASE WHEN n / greatest(per_week, 0.5::DOUBLE) >= 5 THEN least(n / greatest(per_week, 0.5::DOUBLE) * 3, 30.0::DOUBLE) ELSE 0 END
    + CASE WHEN night > 0 THEN least(night * 25, 20) ELSE 0 END + CASE WHEN n >= 10 THEN 15 ELSE 0 END, 100.0::DOUBLE), 4) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM (
    SELECT user_id, ts, count(*) OVER w AS n, len(list_distinct(list(CASE WHEN hour(ts) < 6 THEN hour(ts) END) OVER w)) AS night,
      CASE WHEN span < 1 THEN total ELSE total / span * 7 END AS per_week
    FROM (SELECT *, count(*) OVER p AS total, (max(epoch_us(ts)) OVER p - min(epoch_us(ts)) OVER p) / 86400000000.0::DOUBLE AS span
      FROM events WINDOW p AS (PARTITION BY user_id))
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOUR FOLLOWING)) WHERE n >= 3) WHERE rn = 1)
WHERE score >= 60""",
    "publisher_change_rapid": """SELECT user_id, ts AS at, previous, event_type AS publisher, gap / 1000000 AS gap_s FROM (
  SELECT user_id, ts, event_type, lag(event_type) OVER o AS previous, epoch_us(ts) - lag(epoch_us(ts)) OVER o AS gap,
    count(*) OVER (PARTITION BY user_id, event_type) AS own
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_type))
WHERE previous <> event_type AND gap <= 600000000 AND own >= 2""",
    "hot_pull_gap": f"""SELECT user_id, min(gap) / 1000000 AS shortest_s, count(*) AS pulls FROM (SELECT user_id, {_GAP.format('')} AS gap FROM events)
WHERE gap > 0 AND gap < 1200000000 GROUP BY user_id""",
    "publisher_drift_last3": _PUBLISHED + """SELECT user_id, array_to_string(list_sort(list_distinct(list_filter(late, lambda x: NOT list_contains(early, x)))), ',') AS new_publishers FROM (
  SELECT user_id, list(publisher) FILTER (WHERE rn <= 3) AS late, coalesce(list(publisher) FILTER (WHERE rn > 3), []) AS early FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n
    FROM e) WHERE n >= 4 GROUP BY user_id)
WHERE len(list_filter(late, lambda x: NOT list_contains(early, x))) > 0""",
    "publisher_drift_spike": _PUBLISHED + """, b AS (SELECT user_id, min(ts) AS t0 FROM (
  SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 6 HOUR FOLLOWING) AS n FROM e) WHERE n >= 3 GROUP BY user_id),
g AS (SELECT user_id, list(publisher) FILTER (WHERE ts >= t0 AND ts <= t0 + INTERVAL 6 HOUR) AS late, coalesce(list(publisher) FILTER (WHERE ts < t0), []) AS early
  FROM e JOIN b USING (user_id) GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_distinct(list_filter(late, lambda x: NOT list_contains(early, x)))), ',') AS new_publishers FROM g
WHERE len(early) > 0 AND len(list_filter(late, lambda x: NOT list_contains(early, x))) > 0""",
    "gap_then_fix": """SELECT user_id, min(ts) AS at FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER o AS before, lead(epoch_us(ts)) OVER o - epoch_us(ts) AS after
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts))
WHERE before >= 43200000000 AND event_type = 'click' AND after <= 172800000000 GROUP BY user_id""",
    "tag_repoint": """SELECT user_id, event_id, 'latest' AS tag, gap / 1000000 AS gap_s FROM (
  SELECT *, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - epoch_us(ts) AS gap FROM events)
WHERE gap < 3600000000 AND event_type = 'purchase'""",
    "backfill_span": """WITH v AS (SELECT user_id, event_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(floor(user_id % 7 * 40000 * (event_id % 10) / 10) AS BIGINT)) AS ts FROM events)
SELECT user_id, count(*) AS versions, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 3600000000.0::DOUBLE, 4) AS span_h,
  max(event_id % 3) - min(event_id % 3) AS major_span, count(DISTINCT event_id % 5) AS minors, 80 AS score FROM v GROUP BY user_id
HAVING count(*) >= 8 AND (max(epoch_us(ts)) - min(epoch_us(ts))) / 3600000000.0 < 24 AND (max(event_id % 3) - min(event_id % 3) >= 1 OR count(DISTINCT event_id % 5) >= 4)""",
    "first_attested": """SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type,
  max(CAST(event_type = 'purchase' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS had FROM events)
WHERE event_type = 'purchase' AND had = 0""",
    "zscore_ladder": """WITH s AS (SELECT l_partkey, CAST(floor(l_quantity) * 10000 + floor(l_discount * 100 + 0.5) * 100 + l_linenumber AS BIGINT) AS score, l_linenumber = 1 AS current FROM lineitem),
h AS (SELECT l_partkey, count(*) AS n, avg(score) AS mean, stddev_pop(score) AS sd, max(score) AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC) AS rn FROM s WHERE NOT current) WHERE rn <= 50 GROUP BY l_partkey),
j AS (SELECT *, CASE WHEN sd > 0 THEN (now - mean) / sd ELSE 0.0::DOUBLE END AS z, CASE WHEN top > 0 THEN now / top ELSE 0.0::DOUBLE END AS ratio
  FROM (SELECT l_partkey, max(score) AS now FROM s WHERE current GROUP BY l_partkey) LEFT JOIN h USING (l_partkey))
SELECT l_partkey, round(z, 4) AS z, round(ratio, 4) AS ratio, CASE WHEN coalesce(n, 0) < 2 THEN CASE WHEN now >= 999999 THEN 60 ELSE 0 END
  WHEN now >= 999999 THEN 92 WHEN now % 10000 = 0 AND now / 10000 = floor(top / 10000) + 1 THEN 0
  WHEN z > 10 THEN 90 WHEN z > 5 THEN 85 WHEN z > 3 THEN 72 WHEN ratio > 10 THEN 75 WHEN z > 2 THEN 55 ELSE 0 END AS score FROM j""",
    "line_window": """WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line, unnest(x) AS content FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
SELECT doc_id, CAST(line AS INT) AS line FROM (SELECT *, bool_or(regexp_matches(content, '[0-9]{2}')) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM l)
WHERE contains(content, 'the ') AND near""",
    "cache_prune": """SELECT p_partkey, CAST(running AS BIGINT) AS running, total <= 20000.0 OR running <= 16000.0 AS stays FROM (SELECT p_partkey, sum(p_size) OVER (ORDER BY p_retailprice DESC, p_partkey DESC ROWS UNBOUNDED PRECEDING) AS running,
  sum(p_size) OVER () AS total FROM part)""",
}
