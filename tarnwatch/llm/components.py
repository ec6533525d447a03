"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    out = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    to_least = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
    return to_least.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a != b").distinct()


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b: long) to (a, b): every linked node but the smallest with the smallest of its component.

    Each round is written to the shared folder, which cuts lineage. Rounds end when the edges stay the same;
    they grow with the logarithm of the longest chain, and running out of rounds is an error."""
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    seen = mark(now)
    for _ in range(most_rounds):
        if not seen[0]:
            return now
        now = written(_small_star(_large_star(now)), "links")
        if (new := mark(now)) == seen:
            return now
        seen = new
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
