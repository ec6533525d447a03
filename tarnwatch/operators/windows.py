"""Publish-time rules: bursts, gaps, drifts and version histories, one window per package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.sources.scratch import written

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def anchored_burst(versions: DataFrame, key: str, ts: str, within: int, least: int) -> DataFrame:
    """Per key the first version from which `least` or more follow within `within` microseconds, itself included."""
    at = versions.select(key, F.col(ts).alias("burst_start"), micros(ts).alias("__t"))
    frame = Window.partitionBy(key).orderBy("__t").rangeBetween(0, within)
    counted = at.withColumn("n", F.count("*").over(frame)).where(F.col("n") >= least)
    return counted.groupBy(key).agg(F.min("burst_start").alias("burst_start"), F.min_by("n", "__t").alias("versions_in_burst"))


def burst_score(versions: DataFrame, key: str, ts: str, within: int = DAY, least: int = 3) -> DataFrame:
    """The maintainer burst: how far it exceeds the usual pace, night hours and size add to a base of 40; 60 and over."""
    at = versions.select(key, F.col(ts).alias("burst_start"), micros(ts).alias("__t"), F.hour(F.col(ts).cast("timestamp")).alias("h"))
    frame = Window.partitionBy(key).orderBy("__t").rangeBetween(0, within)
    whole = Window.partitionBy(key)
    night = F.size(F.collect_set(F.when(F.col("h") < 6, F.col("h"))).over(frame))
    span = (F.max("__t").over(whole) - F.min("__t").over(whole)) / DAY
    total = F.count("*").over(whole)
    at = at.select(key, "burst_start", "__t", F.count("*").over(frame).alias("n"), night.alias("night"), F.when(span < 1, total.cast("double")).otherwise(total / span * 7).alias("per_week"))
    first = at.where(F.col("n") >= least).groupBy(key).agg(F.min_by(F.struct("burst_start", "n", "night", "per_week"), "__t").alias("b")).select(key, "b.*")
    times = F.col("n") / F.greatest("per_week", F.lit(0.5))
    score = (
        F.lit(40.0)
        + F.when(times >= 5, F.least(times * 3, F.lit(30.0))).otherwise(0.0)
        + F.when(F.col("night") > 0, F.least(F.col("night") * 25, F.lit(20)).cast("double")).otherwise(0.0)
        + F.when(F.col("n") >= 10, 15.0).otherwise(0.0)
    )
    return first.select(key, "burst_start", "n", "night", F.round(F.least(score, F.lit(100.0)), 4).alias("score")).where("score >= 60")


def propagation_score(versions: DataFrame, key: str, ts: str) -> DataFrame:
    """The one-hour burst of three, scored 60 plus up to 25 by its size."""
    b = anchored_burst(versions, key, ts, HOUR, 3)
    return b.withColumn("score", F.lit(60) + F.least(F.col("versions_in_burst") * 5, F.lit(25)))


def rapid_publisher_change(versions: DataFrame, key: str, ts: str, publisher: str, within: int, least: int) -> DataFrame:
    """Neighbouring versions of different publishers, close in time, the new one with `least` versions or more."""
    order = Window.partitionBy(key).orderBy("__t", publisher)
    v = versions.withColumn("__t", micros(ts))
    v = v.withColumns({
        "previous": F.lag(publisher).over(order),
        "gap": F.col("__t") - F.lag("__t").over(order),
        "own": F.count("*").over(Window.partitionBy(key, publisher)),
    })
    hit = (F.col("previous") != F.col(publisher)) & (F.col("gap") <= within) & (F.col("own") >= least)
    return v.where(hit).select(key, F.col(ts).alias("at"), "previous", F.col(publisher).alias("publisher"), (F.col("gap") / 1_000_000).alias("gap_s"))


def hot_pull(versions: DataFrame, key: str, ts: str, within: int = 20 * MINUTE) -> DataFrame:
    """Versions replaced within minutes: the shortest gap above zero, and how many there are."""
    v = versions.select(key, micros(ts).alias("__t"))
    gap = F.col("__t") - F.lag("__t").over(Window.partitionBy(key).orderBy("__t"))
    v = v.withColumn("gap", gap).where((F.col("gap") > 0) & (F.col("gap") < within))
    return v.groupBy(key).agg((F.min("gap") / 1_000_000).alias("shortest_s"), F.count("*").alias("pulls"))


def publisher_drift(versions: DataFrame, key: str, ts: str, publisher: str, tie: str, last: int = 3, least: int = 4) -> DataFrame:
    """Publishers of the last versions that none of the earlier ones has."""
    w = Window.partitionBy(key)
    v = versions.withColumn("rn", F.row_number().over(w.orderBy(F.col(ts).desc(), F.col(tie).desc()))).withColumn("n", F.count("*").over(w))
    v = v.where(F.col("n") >= least).groupBy(key).agg(
        F.collect_set(F.when(F.col("rn") <= last, F.col(publisher))).alias("late"),
        F.collect_set(F.when(F.col("rn") > last, F.col(publisher))).alias("early"),
    )
    new = F.array_sort(F.array_except("late", "early"))
    return v.where(F.size(new) > 0).select(key, F.concat_ws(",", new).alias("new_publishers"))


def spike_drift(versions: DataFrame, key: str, ts: str, publisher: str, within: int = 6 * HOUR, least: int = 3) -> DataFrame:
    """After a spike: publishers inside it who had published nothing before it began."""
    spike = anchored_burst(versions, key, ts, within, least).select(F.col(key).alias("__k"), micros("burst_start").alias("__from"))
    v = versions.select(key, publisher, micros(ts).alias("__t")).join(spike, F.col(key) == F.col("__k"))
    g = v.groupBy(key).agg(
        F.collect_set(F.when((F.col("__t") >= F.col("__from")) & (F.col("__t") <= F.col("__from") + within), F.col(publisher))).alias("inside"),
        F.collect_set(F.when(F.col("__t") < F.col("__from"), F.col(publisher))).alias("before"),
    )
    new = F.array_sort(F.array_except("inside", "before"))
    return g.where((F.size(new) > 0) & (F.size("before") > 0)).select(key, F.concat_ws(",", new).alias("new_publishers"))


def gap_then_fix(versions: DataFrame, key: str, ts: str, flagged: Column, gap: int, fix: int) -> DataFrame:
    """Per key the first flagged version after a long silence that is followed quickly."""
    order = Window.partitionBy(key).orderBy("__t")
    v = versions.withColumn("__t", micros(ts)).withColumns({"__f": flagged})
    v = v.withColumns({"before": F.col("__t") - F.lag("__t").over(order), "after": F.lead("__t").over(order) - F.col("__t")})
    v = v.where((F.col("before") >= gap) & F.col("__f") & (F.col("after") <= fix))
    return v.groupBy(key).agg(F.min(ts).alias("at"))


def tag_repoint(versions: DataFrame, tags: DataFrame, key: str, version: str, ts: str, within: int = HOUR) -> DataFrame:
    """Tagged versions whose next version came within the hour."""
    order = Window.partitionBy(key).orderBy("__t", version)
    v = versions.withColumn("__t", micros(ts)).withColumn("next_gap", F.lead("__t").over(order) - F.col("__t"))
    v = v.where(F.col("next_gap") < within)
    return v.join(tags, [key, version]).select(key, version, "tag", (F.col("next_gap") / 1_000_000).alias("gap_s"))


def backfill_span(versions: DataFrame, key: str, ts: str, major: Column, minor: Column, least: int = 8, within: int = DAY, reputable: DataFrame | None = None) -> DataFrame:
    """Many versions in a day that span a major or four minors: a history made up afterwards. Scores 80. Reputable names
    are left out."""
    if reputable is not None:
        versions = versions.join(reputable.select(F.col("name").alias(key)).distinct(), key, "left_anti")
    a = versions.select(key, micros(ts).alias("__t"), major.alias("ma"), minor.alias("mi")).where("ma IS NOT NULL AND mi IS NOT NULL")
    a = a.groupBy(key).agg(
        F.count("*").alias("versions"),
        ((F.max("__t") - F.min("__t")) / HOUR).alias("span_h"),
        (F.max("ma") - F.min("ma")).alias("major_span"),
        F.countDistinct("mi").alias("minors"),
    )
    hit = (F.col("versions") >= least) & (F.col("span_h") < within / HOUR) & ((F.col("major_span") >= 1) | (F.col("minors") >= 4))
    return a.where(hit).select(key, "versions", F.round("span_h", 4).alias("span_h"), "major_span", "minors", F.lit(80).alias("score"))


def first_attested(versions: DataFrame, key: str, order_by: list[str], attested: Column) -> DataFrame:
    """Attested versions whose two predecessors had no attestation."""
    w = Window.partitionBy(key).orderBy(*order_by)
    v = versions.withColumn("__a", attested.cast("int")).withColumn("had", F.max("__a").over(w.rowsBetween(-2, -1)))
    return v.where("__a = 1 AND had = 0")


def zscore_ladder(scores: DataFrame, key: str, score: str, current: str, keep: int = 50) -> DataFrame:
    """The current version's score against the `keep` highest of its history: sentinel, z and ratio steps.

    Versions in 'major.0.0' of the next major are exempt; under two versions of history only the sentinel counts."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc())
    history = scores.where(~F.col(current)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
    h = history.groupBy(key).agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.max(score).alias("top")
    )
    now = scores.where(F.col(current)).groupBy(key).agg(F.max(score).alias("now"))
    j = now.join(h, key, "left")
    z = F.when(F.col("sd") > 0, (F.col("now") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    ratio = F.when(F.col("top") > 0, F.col("now") / F.col("top")).otherwise(0.0)
    sentinel = F.col("now") >= 99 * 10000 + 99 * 100 + 99
    next_major = (F.col("now") % 10000 == 0) & (F.col("now") / 10000 == F.floor(F.col("top") / 10000) + 1)
    s = (
        F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, F.when(sentinel, 60).otherwise(0))
        .when(sentinel, 92).when(next_major, 0).when(z > 10, 90).when(z > 5, 85).when(z > 3, 72).when(ratio > 10, 75).when(z > 2, 55).otherwise(0)
    )
    return j.select(key, F.round(z, 4).alias("z"), F.round(ratio, 4).alias("ratio"), s.alias("score"))


def neighbours(lines: DataFrame, key: str, at: str, anchor: Column, near: Column, reach: int = 5) -> DataFrame:
    """Anchor lines with the other sign within `reach` lines of them."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(-reach, reach)
    l = lines.withColumns({"__a": anchor, "__n": near.cast("int")})
    return l.withColumn("__near", F.max("__n").over(w)).where(F.col("__a") & (F.col("__near") == 1)).select(key, at)


def cache_prune(entries: DataFrame, size: str, ts: str, tie: str, limit: float, keep_share: float = 0.8) -> DataFrame:
    """Which cache entries stay when the oldest go until the rest fits into a share of the limit.

    A running sum over all entries, in range partitions: each sums its own, and the sums of those before it, one row a
    partition, are added. The partitions are written once, so that both passes see the same ones, also after a loss."""
    order = [F.col(ts).desc(), F.col(tie).desc()]
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(entries.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "prune")
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Ranges do not overlap, so the place of a partition's first row tells its place among the partitions.
    own = dealt.withColumns({"__run": F.sum(size).over(inside)})
    sums = own.groupBy("__part").agg(F.sum(size).alias("__sum"), F.max(F.struct(ts, tie)).alias("__first"))
    before = Window.orderBy(F.col("__first").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__off"), F.sum("__sum").over(Window.partitionBy()).alias("__all"))
    j = own.join(F.broadcast(offsets), "__part").withColumn("running", F.col("__run") + F.col("__off"))
    return j.withColumn("stays", (F.col("__all") <= limit) | (F.col("running") <= limit * keep_share)).drop("__part", "__run", "__off", "__all")
