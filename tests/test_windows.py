"""Publish-time rules on small made-up histories."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tarnwatch.operators import windows as W

T0 = datetime(2024, 1, 1)


def history(spark, minutes, who=None):
    who = who or ["a"] * len(minutes)
    return spark.createDataFrame([("p", T0 + timedelta(minutes=m), w, i) for i, (m, w) in enumerate(zip(minutes, who, strict=True))], "package string, ts timestamp, publisher string, n int")


def test_burst_is_anchored_and_inclusive(spark):
    r = W.anchored_burst(history(spark, [0, 10, 29, 31, 300]), "package", "ts", 30 * W.MINUTE, 3).collect()
    assert [(x["burst_start"], x["versions_in_burst"]) for x in r] == [(T0, 3)]
    r = W.anchored_burst(history(spark, [0, 15, 30]), "package", "ts", 30 * W.MINUTE, 3).collect()
    assert r[0]["versions_in_burst"] == 3


def test_drift_needs_four_versions(spark):
    d = history(spark, [0, 1, 2, 3, 4], ["a", "a", "b", "b", "b"])
    assert W.publisher_drift(d, "package", "ts", "publisher", "n").first()["new_publishers"] == "b"
    assert W.publisher_drift(history(spark, [0, 1, 2], ["a", "b", "b"]), "package", "ts", "publisher", "n").count() == 0


def test_gap_then_fix(spark):
    day = 24 * 60
    for after, n in ((5 * 60, 1), (30 * 60, 0)):
        v = history(spark, [0, 31 * day, 31 * day + after])
        assert W.gap_then_fix(v, "package", "ts", F.col("n") == 1, 30 * W.DAY, W.DAY).count() == n


def test_backfill(spark):
    for n, hours, want in ((8, 3, 1), (7, 3, 0), (8, 48, 0)):
        v = history(spark, [60 * hours * i / n for i in range(n)])
        assert W.backfill_span(v, "package", "ts", F.col("n") % 2, F.col("n") % 4).count() == want


def test_zscore_sentinel_and_next_major(spark):
    past = [("p", 10000 + i, False) for i in range(5)] + [("q", 10000 + i, False) for i in range(5)]
    d = spark.createDataFrame([*past, ("p", 999999, True), ("q", 20000, True)], "package string, score long, current boolean")
    assert {r["package"]: r["score"] for r in W.zscore_ladder(d, "package", "score", "current").collect()} == {"p": 92, "q": 0}


def test_first_attested(spark):
    v = history(spark, [0, 1, 2, 3], ["x", "x", "yes", "yes"])
    assert [r["n"] for r in W.first_attested(v, "package", ["ts"], F.col("publisher") == "yes").collect()] == [2]
