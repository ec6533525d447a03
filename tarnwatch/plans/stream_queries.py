"""The streaming extension over events that have landed, drained once."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tarnwatch.sources import scratch
from tarnwatch.sources.tables import table
from tarnwatch.streaming import bursts as B
from tarnwatch.streaming.anchored import anchored_bursts


def _folder(s) -> str:
    return f"{scratch.folder(s)}/stream-{uuid4().hex}"


def _landed(s, d, times: int = 1):
    """The events as files in a folder of their own, sent `times` times."""
    e = table(s, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    folder = _folder(s)
    for _ in range(times):
        e.write.mode("append").parquet(f"{folder}/in")
    return B.landed(s, f"{folder}/in", e.schema, 1000), folder


def _repeats(s, d):
    stream, folder = _landed(s, d, 2)
    return B.drained(B.once(stream, ["event_id"], "ts", "400 days"), folder).select("event_id", "user_id", "event_type")


def _bursts(s, d):
    stream, folder = _landed(s, d)
    return B.drained(B.bursts(stream, "event_type", "ts", 30, 2), folder)


def _sessions(s, d):
    stream, folder = _landed(s, d)
    return B.drained(B.publish_sessions(stream, "user_id", "ts"), folder)


def _anchored(s, d):
    stream, folder = _landed(s, d)
    return B.drained(anchored_bursts(stream, "user_id", "ts", 600, 3), folder)


QUERIES = {"stream_anchored_bursts": _anchored, "stream_repeats": _repeats, "stream_bursts": _bursts, "stream_sessions": _sessions}

_LAST = "(SELECT max(epoch_us(ts)) - 7200000000 FROM events)"
ORACLE = {
    "stream_anchored_bursts": f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE user_id IS NOT NULL),
c AS (SELECT user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN CURRENT ROW AND 36000000000 FOLLOWING) AS n FROM e)
SELECT user_id, make_timestamp(min(t)) AS burst_start, arg_min(n, t) AS versions_in_burst FROM c WHERE n >= 3 AND t + 36000000000 < {_LAST} GROUP BY user_id""",
    "stream_repeats": "SELECT event_id, user_id, event_type FROM events",
    "stream_bursts": f"""WITH w AS (SELECT event_type, (epoch_us(ts) // 360000000 - k) * 360000000 AS a FROM events, range(5) r(k))
SELECT event_type, make_timestamp(a) AS "from", make_timestamp(a + 1800000000) AS until, count(*) AS versions FROM w WHERE a + 1800000000 <= {_LAST} GROUP BY event_type, a HAVING count(*) >= 2""",
    "stream_sessions": f"""WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER o < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, make_timestamp(min(t)) AS "from", make_timestamp(max(t) + 1800000000) AS until, count(*) AS versions FROM s GROUP BY user_id, no HAVING max(t) + 1800000000 <= {_LAST}""",
}
