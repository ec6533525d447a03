"""Incremental rescans: snapshots of packages arrive as a stream, and only packages whose contents changed are scanned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digests(files: DataFrame) -> DataFrame:
    """package, digest: one number of all (path, content) that a package has, whatever their order, and how many."""
    one = F.xxhash64("path", F.sha2(F.coalesce("content", F.lit("")), 256))
    return files.where("package IS NOT NULL").groupBy("package").agg(F.concat_ws("-", F.count("*").cast("string"), F.bit_xor(one).cast("string"), F.sum(one.cast("decimal(38,0)")).cast("string")).alias("digest"))


def latest(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table of the last snapshot that was taken in whole."""
    n = committed(spark, path)
    return spark.createDataFrame([], schema) if n is None else spark.read.schema(schema).parquet(f"{path}/{name}/snapshot={n}")


def committed(spark: SparkSession, path: str) -> int | None:
    """The number of the last whole snapshot; the row that says so is written after its tables."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return None
    return spark.read.schema("snapshot long").parquet(f"{path}/done").agg(F.max("snapshot")).first()[0]


def take(snapshot: DataFrame, number: int, path: str, scan: Callable[[DataFrame], DataFrame], schema: str) -> None:
    """One snapshot (package, path, content): scans what changed since the last, keeps findings of what did not, and
    drops those of packages that are gone. A snapshot taken again, or after a loss half way, gives the same tables."""
    spark = snapshot.sparkSession
    last = committed(spark, path)
    if last is not None and last >= number:
        return
    now, before = digests(snapshot), latest(spark, path, "digests", "package string, digest string")
    now.write.mode("overwrite").parquet(f"{path}/digests/snapshot={number}")
    now = spark.read.parquet(f"{path}/digests/snapshot={number}")
    changed = now.join(before, ["package", "digest"], "left_anti").select("package")
    same = now.join(before, ["package", "digest"], "left_semi").select("package")
    files = snapshot.join(changed, "package", "left_semi")
    columns = [c.split()[0] for c in schema.split(", ")]
    kept = latest(spark, path, "findings", f"{schema}, scanned_in long").join(same, "package", "left_semi")
    fresh = scan(files).select(*columns, F.lit(number).cast("long").alias("scanned_in"))
    kept.select(*columns, "scanned_in").unionByName(fresh).write.mode("overwrite").parquet(f"{path}/findings/snapshot={number}")
    files.agg(F.count("*").alias("files"), F.count_distinct("package").alias("packages")).withColumn("snapshot", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/read/snapshot={number}")
    spark.range(number, number + 1).select(F.col("id").alias("snapshot")).write.mode("append").parquet(f"{path}/done")


def rescans(snapshots: DataFrame, path: str, scan: Callable[[DataFrame], DataFrame], schema: str) -> None:
    """A stream of snapshots, one a micro-batch, taken one after the other; what has landed is drained."""
    q = snapshots.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(lambda batch, n: take(batch, n, path, scan, schema)).start()
    q.awaitTermination()
