"""What the operators share: the shared scratch folder, shipping the package, safe names."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and all runs in one process, a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"{tempfile.gettempdir()}/tarnwatch-shared"
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: computed once, lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give executors this package, for functions that run in Python there, and keep their Arrow batches small:
    texts can be long, and a worker holds a batch as Arrow, as objects and as output."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(app)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def one_row_each(rows: DataFrame, key: list[str], rest: list[str]) -> DataFrame:
    """Of rows that share a key those of the smallest rest: what repeats ends before the exchange."""
    least = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__least"))
    return least.select(*key, *[F.col(f"__least.{c}").alias(c) for c in rest])


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def text_mixes(text: Column) -> tuple[Column, Column]:
    """Two hashes that together stand for a text: mix and mix2."""
    return F.xxhash64(text).alias("mix"), F.xxhash64(F.lit(1), text).alias("mix2")


def keep_rows(docs: DataFrame, key: Column, kept: DataFrame, salts: int = 64) -> DataFrame:
    """Whole rows of docs whose key is in kept ("__key", once for each row that has it), each key once.

    One exchange of docs. Keys that rows repeat are known from kept; only where there are any do their rows go a
    second way, spread over `salts` parts of which each leaves one row a key."""
    counted = written(kept.groupBy("__key").agg(F.count("*").alias("__n")), "kept-keys")
    own = docs.withColumn("__key", key)
    once = own.join(counted.where("__n = 1").select("__key"), "__key", "left_semi")
    repeated = counted.where("__n > 1").select("__key")
    if repeated.isEmpty():
        return once.select(*docs.columns)
    parts = repeated.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = own.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    some = spread.join(parts, ["__key", "__salt"], "left_semi").dropDuplicates(["__key", "__salt"])
    return once.unionByName(some.dropDuplicates(["__key"]).drop("__salt")).select(*docs.columns)


def row_key(id_col: str, *parts: Column) -> Column:
    """Id and further parts as one join key; no two lists of values have the same one, and a null id has its own."""
    own = F.col(id_col).cast("string")
    return F.struct(own.isNull().alias("n"), F.coalesce(own, F.lit("")).alias("id"), *[p.cast("string").alias(f"p{k}") for k, p in enumerate(parts)])


def spread_join(rows: DataFrame, one_per_key: DataFrame, key: str, salts: int = 64, share: int = 1000) -> DataFrame:
    """rows left-joined with a table of one row per key that also counts them ("__n").

    Keys of more than 1/share of all rows are at most `share` many; that list, of proven size, is broadcast and
    tells rows of hot keys to spread over `salts` copies of their key's row."""
    total = one_per_key.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot = written(one_per_key.where(F.col("__n") * share > total).select(F.col(key).alias("__hot")), "hot-keys")
    marked = one_per_key.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left")
    copies = F.when(F.col("__hot").isNotNull(), F.lit(salts - 1)).otherwise(F.lit(0))
    laid = marked.withColumn("__salt", F.explode(F.sequence(F.lit(0), copies))).drop("__hot", "__n")
    laid = laid.withColumnRenamed(key, "__key")
    own = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("__hot")), "left")
    spread = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    own = own.withColumn("__own", spread).drop("__hot")
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__salt"))
    return own.join(laid, on, "left").drop("__key", "__salt", "__own")
