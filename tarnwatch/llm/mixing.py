"""Mixing sources to target weights.

Words are summed per source; sources in code point order (null last) weigh `weights`, repeating, and share the
words of the whole corpus, none beyond `most` times its own size: the excess goes to the others by weight until
none is above. That fixed point is the level L at which sum(min(most * size, L * weight)) = total; sources
capped at it are those of the smallest most * size / weight, so one ordered pass over the sources finds it.

A document is taken floor(rate) times, and once more with the probability of the fraction: a draw that is a
hash of its id and a seed. Each source has its own seed: of `seeds` candidates the one whose draws together come
nearest the target, found by one aggregation that sums all candidates at once. So reruns agree, and the words
taken come near the target also where few documents make up a source.

Defined results: null text has size 0; a null source is a source of its own; a source without words has target
0 and rate 0; repeated rows draw alike; null ids draw by the size of their text; very long
texts are counted whole; an empty table gives an empty
result; columns that have names of ours are kept as they are, since ours get reserved names until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: Column) -> Column:
    """Uniform in [0, 1) from id, size and seed."""
    h = F.xxhash64(F.xxhash64(F.col("__id"), F.col("__size")), seed)
    return F.pmod(h, F.lit(1 << 40)).cast("double") / float(1 << 40)


def copies(rate: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (draw(seed) < rate - whole).cast("long")).cast("long")


def targets(sources: DataFrame, weights=(5, 2, 1), most: float = 3.0) -> DataFrame:
    """sources: __source, __total (words). Adds __target. Rows here are sources, not documents."""
    order = Window.orderBy(F.col("__source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weighed = sources.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("__cap", F.col("__total") * F.lit(float(most)))
    rising = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("__total").over(Window.partitionBy())
    level = (everything - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(rest)
    # The level at the first source that stays below its cap is the level of all after it.
    found = weighed.withColumn("__level", level).withColumn("__free", F.col("__level") * F.col("__w") <= F.col("__cap"))
    at = F.min(F.when(F.col("__free"), F.struct((F.col("__cap") / F.col("__w")).alias("a"), F.col("__source").isNull().alias("b"), F.col("__source").alias("c"), F.col("__level").alias("level"))))
    found = found.withColumn("__final", at.over(Window.partitionBy())["level"])
    goal = F.least(F.col("__cap"), F.coalesce("__final", F.lit(0.0)) * F.col("__w"))
    return found.select("__source", "__total", goal.alias("__target"))


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, most: float, seeds: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """The sizes of documents, written once, and per source: total, target, rate, seed."""
    rows = written(
        docs.select(
            F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size")
        ),
        "mix-sizes",
    )
    sources = rows.groupBy("__source").agg(F.sum("__size").alias("__total"))
    rates = written(
        targets(sources, weights, most).withColumn(
            "__rate", F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(0.0)
        ),
        "mix-rates",
    )
    sums = with_source(rows, rates, salts).groupBy("__source").agg(
        *[F.sum(copies(F.col("__rate"), F.lit(k)) * F.col("__size")).alias(f"__s{k}") for k in range(seeds)]
    )
    off = rates.join(sums.withColumnRenamed("__source", "__o"), F.col("__source").eqNullSafe(F.col("__o")))
    miss = F.array(*[F.struct(F.abs(F.col(f"__s{k}") - F.col("__target")).alias("miss"), F.lit(k).alias("seed")) for k in range(seeds)])
    seeded = off.select("__source", "__total", "__target", "__rate", F.array_min(miss)["seed"].alias("__seed"))
    return rows, written(seeded, "mix-plan")


def with_source(rows: DataFrame, per_source: DataFrame, salts: int, broadcast_rows: int = 20_000) -> DataFrame:
    """rows with what their source has. A checked count of sources decides: few are broadcast; many are joined
    with each source laid out over `salts` keys, so that a source of a third of all rows meets many tasks."""
    given = per_source.withColumnRenamed("__source", "__src")
    if given.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(given), F.col("__source").eqNullSafe(F.col("__src")), "left").drop("__src")
    given = given.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__own", F.pmod(F.xxhash64("__id", "__size"), F.lit(salts)).cast("int"))
    joined = salted.join(given, F.col("__source").eqNullSafe(F.col("__src")) & (F.col("__own") == F.col("__salt")), "left")
    return joined.drop("__src", "__own", "__salt")


def mix_plan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=(5, 2, 1), most: float = 3.0, seeds: int = 64, salts: int = 64,
) -> DataFrame:
    """Per row: id, source, size, source_size, target, rate, copies, taken."""
    rows, per_source = plan(docs, id_col, text_col, source_col, weights, most, seeds, salts)
    n = copies(F.col("__rate"), F.col("__seed"))
    return with_source(rows, per_source, salts).select(
        F.col("__id").alias(id_col),
        F.col("__source").alias(source_col),
        F.col("__size").alias("size"),
        F.col("__total").cast("long").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__rate").alias("rate"),
        n.alias("copies"),
        (n * F.col("__size")).alias("taken"),
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=(5, 2, 1), most: float = 3.0, seeds: int = 64, salts: int = 64,
) -> DataFrame:
    """The mixed corpus: whole rows of docs, each as often as it is taken. Texts are not shuffled."""
    _, per_source = plan(docs, id_col, text_col, source_col, weights, most, seeds, salts)
    own = docs.withColumns(
        {"__id": F.col(id_col), "__source": F.col(source_col), "__size": word_count(F.col(text_col))}
    )
    n = copies(F.col("__rate"), F.col("__seed"))
    out = with_source(own, per_source, salts).withColumn("__n", n).where("__n > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*docs.columns)
