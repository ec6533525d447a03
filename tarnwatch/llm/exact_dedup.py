"""Exact dedup: a tree merge of sorted digest runs, by DataFrame operations alone.

Every row falls into one of `leaves` runs by a hash of its id. A leaf run has one entry per distinct text of its
rows: the identifier that stays so far, and how many rows it stands for. In each round `fan_in` neighbouring runs
(fan_in = 2**k takes k binomial rounds at once) are exchanged, dealt by digest, and merged: sorted by digest and
identifier, entries of one text stand next to each other, at most one from each run, and the first of them, the
identifier that stays, goes on with their sum. A single run at last holds the winner of each text. The winners then
go down the same tree, level by level, to the rows. A text that a third of all rows have is one entry per run on
every level, so no task ever gathers its rows: neither the merge nor the way back joins on the digest alone.

Digests are SHA-256; length and a second 64-bit hash go along in every merge key, so that two texts are taken
for equal only when all three agree ("verified" entries).

Defined results: null text counts as empty; empty texts are equal to each other; of equal texts the row with
the largest (keep="largest") or smallest id stays; null ids lose to any other; rows that repeat both id and text
are the same document, and all of them carry kept = true if that document stays (`drop_copies` leaves one of
them); very long texts are hashed whole; an empty
table gives an empty result; other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.common import keep_rows, row_key, text_or_empty, written

KEY = ["sha", "n_bytes", "mix"]


def leaf_runs(docs: DataFrame, id_col: str, text_col: str, leaves: int) -> DataFrame:
    """(id, run, key): one pass over the texts; nothing later reads them."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(leaves)).cast("int").alias("run"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("mix"),
    )


def merge_level(runs: DataFrame, fan_in: int, keep: str) -> DataFrame:
    """fan_in neighbouring sorted runs become one: an exchange, a sort by digest, and one pass over what is sorted."""
    id_ = F.col("keep_id")
    one = Window.partitionBy("run", *KEY)
    stays = one.orderBy(id_.desc_nulls_last() if keep == "largest" else id_.asc_nulls_last())
    met = runs.withColumn("run", (F.col("run") / fan_in).cast("int"))
    merged = met.withColumn("at", F.row_number().over(stays)).withColumn("total", F.sum("group_size").over(one))
    return merged.where("at = 1").select("run", *KEY, "keep_id", F.col("total").alias("group_size"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", leaves: int = 64, fan_in: int = 8
) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    best = F.max if keep == "largest" else F.min
    rows = written(leaf_runs(docs, id_col, text_col, leaves), "digest-runs")
    levels = [rows.groupBy("run", *KEY).agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))]
    width = leaves
    while width > 1:
        levels.append(merge_level(levels[-1], fan_in, keep))
        width = -(-width // fan_in)
    # Texts of one row need no way down: what is theirs they know.
    winners = written(levels[-1].where("group_size > 1").drop("run"), "digest-winners")
    down = winners.withColumn("run", F.lit(0))
    for below in reversed(levels[:-1]):
        upper = down.withColumnRenamed("run", "up")
        entry = below.select("run", *KEY, (F.col("run") / fan_in).cast("int").alias("up"))
        down = entry.join(upper, ["up", *KEY]).drop("up")
    out = rows.join(down, ["run", *KEY], "left")
    keep_id = F.coalesce("keep_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """docs without exact copies, whole rows. Of rows that repeat id and text, one stays."""

    kept = exact_groups(docs, id_col, text_col, keep).where("kept")
    kept = kept.select(row_key(id_col, F.col("text_sha256")).alias("__key"))
    return keep_rows(docs, row_key(id_col, F.sha2(text_or_empty(text_col), 256)), kept)
