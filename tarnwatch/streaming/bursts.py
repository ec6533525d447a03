"""An extension beyond batch rules: publish events as a stream.

Bursts on a stream are sliding windows with a watermark. A window of `within` that slides by a fifth of it holds at
least the events of any anchored window of four fifths of it, so `least` events that close are always reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def landed(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(events: DataFrame, keys: list[str], ts: str, late: str = "2 hours") -> DataFrame:
    """Each version once, whatever was sent again within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def bursts(events: DataFrame, key: str, ts: str, within_minutes: int = 30, least: int = 3, late: str = "2 hours") -> DataFrame:
    """Windows in which a package publishes `least` versions or more."""
    slide = max(1, within_minutes // 5)
    w = F.window(F.col(ts), f"{within_minutes} minutes", f"{slide} minutes")
    counted = events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("versions"))
    return counted.where(F.col("versions") >= least).select(key, F.col("window.start").alias("from"), F.col("window.end").alias("until"), "versions")


def publish_sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of publishing with gaps of at most `gap`."""
    s = F.session_window(F.col(ts), gap)
    return events.withWatermark(ts, late).groupBy(s, key).agg(F.count("*").alias("versions")).select(key, F.col("session_window.start").alias("from"), F.col("session_window.end").alias("until"), "versions")


def drained(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream has by now, appended to files under a shared folder, as a table: what its watermark still
    holds back stays in the checkpoint for the next run."""
    q = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").format("parquet").start(f"{path}/rows")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
