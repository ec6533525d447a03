"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

A document is its token ids and an end id; one longer than the sequence is cut into whole sequences, and what is left
over is its first piece. Pieces over half a sequence can never share one, so each opens a sequence of its own, and as
many empty ones are opened as the rest needs at least. Then rounds run over pieces still to place and gaps still open:

* both are range-sorted by size, a piece before a gap of its size;
* each task sweeps its range: a gap takes the nearest piece below it that no smaller gap has taken, as brackets match;
* what a range cannot match itself are gaps below all its free pieces, then free pieces. Their counts, one row a
  range, decide which ranks of one range's pieces meet which ranks of another's gaps, and a join on rank pairs them;
* gaps shrink by what they took, and the next round begins. A gap of k times the largest piece still to place stands
  as k - 1 slots, so that small pieces do not take a round each.

Where a round places next to nothing, sequences are opened for what is left: every piece then fits, so rounds end.

Defined results: a null text is empty, and an empty text one piece of the end id; rows that repeat, and rows of equal or
null ids, are pieces of their own, never merged; equal sizes are ordered by a row number that the first pass writes;
a text of any length is encoded whole, in one task; an empty table gives an empty result; other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.common import ship, text_or_empty, written

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
SWEPT = "part int, rank long, rid long, length int, bin long, slot int"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: a byte that prints stands for itself,
    the others follow from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def ranks_of(vocabulary: str) -> dict[bytes, int]:
    """Token bytes to ids of a tokenizers file in which ids are in the order of merges."""
    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    letters = byte_alphabet()
    return {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def encoder(vocabulary: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks_of(vocabulary), special_tokens={})


#: One encoder per Python worker.
_ENCODERS: dict[tuple[str, str], object] = {}


def own_encoder(vocabulary: str, pattern: str):
    if (vocabulary, pattern) not in _ENCODERS:
        _ENCODERS[vocabulary, pattern] = encoder(vocabulary, pattern)
    return _ENCODERS[vocabulary, pattern]


def token_pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one pass over the texts. Ids are those of the tokenizers library, with
    strings of special tokens taken as text; tiktoken makes them from the same file in a quarter of the time."""
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = own_encoder(vocabulary, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode.encode_to_numpy(text.as_py(), disallowed_special=()), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(pieces, PIECES)


def matched(is_slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pieces and of the slots they go to, of a range in order of size: a slot takes the last piece before
    it that is still free. Both stand at one height of the running sum, next to each other."""
    height = np.cumsum(np.where(is_slot, -1, 1)) - ~is_slot
    order = np.argsort(height, kind="stable")
    a, b = order[:-1], order[1:]
    met = (height[a] == height[b]) & ~is_slot[a] & is_slot[b]
    return a[met], b[met]


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of pieces and slots: pairs, then what stays free with its rank among the free of its kind."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    column = lambda name: table[name].to_numpy()
    length, is_slot, key, slot = column("size"), column("is_slot") == 1, column("key"), column("slot")
    pieces, slots = matched(is_slot)
    free = np.ones(len(is_slot), bool)
    free[pieces] = free[slots] = False
    rows = np.concatenate([pieces, np.flatnonzero(free & ~is_slot), np.flatnonzero(free & is_slot)])
    n, docs, gaps = len(pieces), int((free & ~is_slot).sum()), int((free & is_slot).sum())
    of_piece, of_slot = np.arange(len(rows)) >= n + docs, (np.arange(len(rows)) >= n) & (np.arange(len(rows)) < n + docs)
    met = np.concatenate([slots, rows[n:]])  # the slot of each row, where it has one
    arrays = [
        pa.array(np.full(len(rows), TaskContext.get().partitionId(), np.int32)),
        pa.array(np.concatenate([np.zeros(n, np.int64), np.arange(docs), np.arange(gaps)])),
        pa.array(key[rows], mask=of_piece),
        pa.array(length[rows].astype(np.int32), mask=of_piece),
        pa.array(key[met], mask=of_slot),
        pa.array(slot[met].astype(np.int32), mask=of_slot),
    ]
    yield from pa.Table.from_arrays(arrays, ["part", "rank", "rid", "length", "bin", "slot"]).to_batches(max_chunksize=100_000)


def meetings(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (range, free pieces, free slots) in order of size: ranks from..to of a range's pieces that meet as many slots
    of a later range, from a rank on. Of each range the last piece is the largest; at most two rows a range."""
    waiting: list[list[int]] = []
    found = []
    for part, docs, slots in counts:
        at = 0
        while at < slots and waiting:
            there, n = waiting[-1]
            k = min(n, slots - at)
            found.append((there, n - k, n, part, at))
            at += k
            waiting[-1][1] -= k
            if not waiting[-1][1]:
                waiting.pop()
        if docs:
            waiting.append([part, docs])
    return found


def slots_of(gaps: DataFrame, least: int, largest: int, waiting: int) -> DataFrame:
    """The gaps that can take a piece, as slots: no more of them than twice the pieces that wait and one for each gap."""
    live = gaps.where(F.col("gap") >= least)
    n = max(1, live.count())
    k = F.expr(f"gap div {largest} - 1")
    slots = F.greatest(F.lit(1), F.least(k, F.lit(1 + 2 * waiting // n))).cast("int")
    return live.withColumn("n", slots).select(
        F.expr("cast(gap div n AS int)").alias("size"), F.lit(1).alias("is_slot"), F.col("bin").alias("key"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot")
    )


def one_round(docs: DataFrame, gaps: DataFrame, stats, rows_per_task: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (rid, length, bin, slot) of a round, and the pieces that stay free (rid, length)."""
    spark = docs.sparkSession
    slots = slots_of(gaps, stats["least"], stats["largest"], stats["n"])
    items = docs.select(F.col("length").alias("size"), F.lit(0).alias("is_slot"), F.col("rid").alias("key"), F.lit(0).alias("slot")).unionByName(slots)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * stats["n"] // rows_per_task + 1)
    order = ["size", "is_slot", "key", "slot"]
    swept = written(items.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(sweep, SWEPT), "packing-swept")
    free_docs, free_slots = swept.where("bin IS NULL"), swept.where("rid IS NULL")
    counts = swept.where("bin IS NULL OR rid IS NULL").groupBy("part").agg(F.count("rid").alias("docs"), F.count("bin").alias("slots"))
    found = meetings(sorted(tuple(r) for r in counts.collect()))  # a row a range
    pairs, left = swept.where("rid IS NOT NULL AND bin IS NOT NULL").select("rid", "length", "bin", "slot"), free_docs.select("rid", "length")
    if not found:
        return pairs, left
    plan = F.broadcast(spark.createDataFrame(found, "part int, since long, until long, there int, at long"))  # two rows a range at most
    planned = free_docs.drop("bin", "slot").join(plan, "part", "left").where("since IS NULL OR rank >= since AND rank < until")
    goes = planned.where("there IS NOT NULL").select("rid", "length", F.col("there").alias("part"), F.expr("at + until - 1 - rank").alias("rank"))
    across = goes.join(free_slots.select("part", "rank", "bin", "slot"), ["part", "rank"]).select("rid", "length", "bin", "slot")
    first = plan.groupBy("part").agg(F.min("since").alias("since"))  # the largest of a range go first: those below stay
    left = free_docs.join(F.broadcast(first), "part", "left").where("since IS NULL OR rank < since").select("rid", "length")
    return pairs.unionByName(across), left


def place(pieces: DataFrame, capacity: int = 2048, rows_per_task: int = 500_000, slow: float = 0.02) -> DataFrame:
    """pieces (rid: unique, length up to capacity) to (rid, length, bin, round, slot): where each goes."""
    spark = pieces.sparkSession
    large = pieces.where(F.col("length") * 2 > capacity)
    docs = pieces.where(F.col("length") * 2 <= capacity).select("rid", "length")
    placed = large.select("rid", "length", F.col("rid").alias("bin"), F.lit(0).alias("round"), F.lit(0).alias("slot"))
    gaps = large.where(F.col("length") < capacity).select(F.col("rid").alias("bin"), (F.lit(capacity) - F.col("length")).cast("int").alias("gap"))
    totals = F.count("*").alias("n"), F.min("length").alias("least"), F.max("length").alias("largest"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")
    stats = docs.agg(*totals).first()
    room = gaps.agg(F.coalesce(F.sum("gap"), F.lit(0))).first()[0]
    opened, to_open, number = 0, -(-(stats["total"] - room) // capacity), 0
    while stats["n"]:
        if to_open > 0:
            fresh = spark.range(-opened - to_open, -opened).select(F.col("id").alias("bin"), F.lit(capacity).alias("gap"))
            gaps, opened = gaps.unionByName(fresh), opened + to_open
        number += 1
        pairs, left = one_round(docs, gaps, stats, rows_per_task)
        pairs = written(pairs, "packing-pairs")
        placed = placed.unionByName(pairs.select("rid", "length", "bin", F.lit(number).alias("round"), "slot"))
        shrunk = gaps.unionByName(pairs.select("bin", (-F.col("length")).alias("gap")))
        gaps = written(shrunk.groupBy("bin").agg(F.sum("gap").cast("int").alias("gap")).where("gap > 0"), "packing-gaps")
        before, docs = stats["n"], left
        stats = docs.agg(*totals).first()
        to_open = -(-stats["total"] // capacity) if before - stats["n"] <= slow * before else 0
    return placed


def pack(
    docs: DataFrame, vocabulary: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", rows_per_task: int = 500_000
) -> DataFrame:
    """Per piece: the id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = token_pieces(docs, vocabulary, pattern, capacity, end_id, id_col, text_col)
    pieces = written(made.withColumn("rid", F.monotonically_increasing_id()), "packing-pieces")
    placed = place(pieces.select("rid", "length"), capacity, rows_per_task)
    before = Window.partitionBy("bin").orderBy("round", "slot").rowsBetween(Window.unboundedPreceding, -1)  # a sequence's pieces: capacity rows at most
    at = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select("rid", "bin", "offset")
    return pieces.join(at, "rid").select(
        F.col("doc_id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )
