"""Parquet readers of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def plain_unions(spark: SparkSession) -> None:
    """Unions lose how their inputs are partitioned. Spark 4.1 keeps it, but pairs the wrong partitions where adaptive
    execution has merged those of the inputs differently, so that a window or sum over a union loses rows of its key."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; a file or a folder of part files."""
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
