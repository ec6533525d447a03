"""The prefix trie of conversations, by an external mergesort that carries longest common prefixes.

1. Turns become tokens of 20 bytes: 16 of the SHA-256 of role and text, 4 of the text's code points. Texts go no further.
2. One exchange, by ranges of ids, brings each block of conversations to a task. It rebuilds them and writes sorted runs:
   distinct sequences in order, each with the turns it shares with the one before, its members' number, smallest id, and ids.
3. A second exchange, by ranges of sequences, brings the parts of all runs to the tasks that merge them by a loser tree.
   Two heads are compared by the turns they share with what was put out last; only equal ones are compared turn by turn,
   from there on. Equal sequences are one entry a run, so a conversation that a third of all rows have is as many.
4. The merged stream keeps the open path on a stack. A sequence that shares less closes nodes, which are finished: their
   counts go up to the parent. Only the paths of a range's first and last sequence may go on in other ranges: their nodes
   are put together by key afterwards, and sums go up those few paths by a window.
5. The ids that end at a node are hashed as a stream in the order of the runs, which is that of the ids.

Defined results: rows without a conversation id belong to none and are left out; a null role or text is empty; turns in
order, null first, rows of one turn by their token; rows that repeat are turns of their own; an empty text is a turn of no
code points; texts of any length are hashed whole, and a conversation is 20 bytes a turn in the task that holds it; an
empty table gives an empty result, without a root; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.common import ship, written

WIDTH = 20  # bytes of a token
RUNS = "run long, pos int, seq binary, lcp int, n long, first long, ids binary"
NODES = (
    "kind string, part int, side int, depth int, key binary, points int, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends boolean, "
    "parent_conv_id long, parent_side int, parent_depth int"
)
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_tokens(conversations: DataFrame) -> DataFrame:
    """conv_id, base (the conversation whose first turns it takes), turn, token."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    points = F.unhex(F.lpad(F.hex(F.length(text)), 8, "0"))
    id_ = F.col("conv_id").cast("long")
    return conversations.where(id_.isNotNull()).select(
        id_.alias("conv_id"), (id_ - id_ % 100).alias("base"), "turn", F.concat(F.substring(digest, 1, 16), points).alias("token")
    )


def key_of(seq: bytes) -> bytes:
    return hashlib.sha256(seq).digest()[:16]


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that a and b begin with together; known: so many they share for certain."""
    at, most = known, min(len(a), len(b)) // WIDTH
    for step in (256, 16, 1):
        while at + step <= most and a[at * WIDTH : (at + step) * WIDTH] == b[at * WIDTH : (at + step) * WIDTH]:
            at += step
    return at


def rebuilt(batches: Iterator[pa.RecordBatch], turns: int = 6) -> Iterator[tuple[int, int, bytes]]:
    """(base, conv_id, sequence) from turns in order of base, the base itself first: the first h turns of the base, then
    its own after h."""
    head_of, head, now, own = None, b"", None, bytearray()

    def done():
        nonlocal head_of, head
        conv, base = now
        if conv == base:
            head_of, head = base, bytes(own[: (turns - 1) * WIDTH])
        h = zlib.crc32(str(conv).encode()) % turns
        return base, conv, (head[: h * WIDTH] if head_of == base else b"") + bytes(own[h * WIDTH :])

    for batch in batches:
        for conv, base, token in zip(batch.column("conv_id").to_pylist(), batch.column("base").to_pylist(), batch.column("token").to_pylist()):
            if now != (conv, base):
                if now:
                    yield done()
                now, own = (conv, base), bytearray()
            own += token
    if now:
        yield done()


def sorted_runs(batches: Iterator[pa.RecordBatch], most: int = 20_000, most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of some `most` conversations; they end where a block of ids does, so those of a later run have greater ids."""
    held: list[tuple[bytes, int]] = []
    size, number, last = 0, 0, None
    part = TaskContext.get().partitionId()

    def run() -> pa.RecordBatch:
        held.sort()
        rows: list[list] = []
        for seq, conv in held:
            if rows and rows[-1][2] == seq:
                rows[-1][6].append(conv)
            else:
                rows.append([part * 2**20 + number, len(rows), seq, shared(rows[-1][2], seq) if rows else 0, 0, conv, [conv]])
        for r in rows:
            r[4], r[6] = len(r[6]), ",".join(map(str, r[6])).encode()
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["run", "pos", "seq", "lcp", "n", "first", "ids"])

    for base, conv, seq in rebuilt(batches):
        if base != last and (len(held) >= most or size >= most_bytes):
            yield run()
            held, size, number = [], 0, number + 1
        held.append((seq, conv))
        size, last = size + len(seq), base
    if held:
        yield run()


class LoserTree:
    """Merges runs of (sequence, lcp, ...): yields entries in order, each with the turns shared with the one before."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.width = 1 << max(0, len(runs) - 1).bit_length()
        self.losers: list[tuple[int, int]] = [(-1, 0)] * self.width

    def head(self, run: int) -> bytes | None:
        return self.runs[run][self.at[run]][0] if 0 <= run < len(self.runs) and self.at[run] < len(self.runs[run]) else None

    def play(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Winner and loser of two (run, turns shared with the last entry put out); the loser's turns are then those
        shared with the winner."""
        one, two = self.head(a[0]), self.head(b[0])
        if one is None or two is None:
            return (b, a) if one is None else (a, b)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        both = shared(one, two, a[1])
        mine, other = one[both * WIDTH : (both + 1) * WIDTH], two[both * WIDTH : (both + 1) * WIDTH]
        if mine < other or mine == other and a[0] < b[0]:
            return a, (b[0], both)
        return b, (a[0], both)

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        won = [(-1, 0)] * self.width + [(r, 0) for r in range(self.width)]
        for node in range(self.width - 1, 0, -1):
            won[node], self.losers[node] = self.play(won[2 * node], won[2 * node + 1])
        now = won[1]
        while self.head(now[0]) is not None:
            run, common = now
            yield common, self.runs[run][self.at[run]]
            self.at[run] += 1
            now = (run, self.runs[run][self.at[run]][1] if self.at[run] < len(self.runs[run]) else 0)
            node = (self.width + run) // 2
            while node:
                now, self.losers[node] = self.play(now, self.losers[node])
                node //= 2


class Node:
    """A node on the open path."""

    __slots__ = ("children", "ends", "first", "leaves", "n", "points", "saved", "waiting")

    def __init__(self, points: int):
        self.points, self.n, self.first, self.children, self.leaves, self.saved, self.ends = points, 0, None, 0, 0, 0, False
        self.waiting: list[list] = []  # finished children, which lack the smallest member of this node

    def meet(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)


def trie_rows(merged: Iterator[tuple[int, tuple]], part: int) -> Iterator[list]:
    """Finished nodes ("node"), and those on the paths of the first and the last sequence ("path"), which other ranges
    may add to; a path's node has what lies below it outside the paths."""
    stack: list[Node] = []
    first_seq, last_seq, first_shared = b"", b"", 0

    def path_row(side: int, depth: int, seq: bytes, node: Node | None) -> Iterator[list]:
        key = key_of(seq[: depth * WIDTH])
        points = int.from_bytes(seq[depth * WIDTH - 4 : depth * WIDTH], "big") if depth else 0
        if node is None:  # counted on the other path
            yield ["path", part, side, depth, key, points, None, 0, 0, 0, 0, False, None, None, None]
            return
        yield ["path", part, side, depth, key, points, node.first, node.n, node.children, node.leaves, node.saved, node.ends, None, None, None]
        for row in node.waiting:
            row[13], row[14] = side, depth
            yield row

    def close(depth: int) -> Iterator[list]:
        node, parent = stack.pop(), stack[-1]
        parent.meet(node.n, node.first)
        if depth <= first_shared:
            yield from path_row(0, depth, first_seq, node)
            return
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.points
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + leaves, parent.saved + saved
        for row in node.waiting:
            row[12] = node.first
            yield row
        key = key_of(last_seq[: depth * WIDTH]) if node.ends else None
        parent.waiting.append(["node", part, None, depth, key, node.points, node.first, node.n, node.children, leaves, saved, node.ends, None, None, None])

    for common, (seq, _, n, first) in merged:
        if stack:
            for depth in range(len(stack) - 1, common, -1):
                yield from close(depth)
            first_shared = min(first_shared, common)
        else:
            stack, first_seq, first_shared = [Node(0)], seq, len(seq) // WIDTH
        for d in range(len(stack), len(seq) // WIDTH + 1):
            stack.append(Node(int.from_bytes(seq[d * WIDTH - 4 : d * WIDTH], "big")))
        stack[-1].meet(n, first)
        stack[-1].ends = True
        last_seq = seq
    if not stack:
        return
    for depth in range(len(stack) - 1, -1, -1):
        node = stack.pop()
        if depth:
            stack[-1].meet(node.n, node.first)
        yield from path_row(1, depth, last_seq, node)
    if first_shared < len(first_seq) // WIDTH:
        for depth in range(first_shared + 1):
            yield from path_row(0, depth, first_seq, None)


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs' parts of one range of sequences, merged into trie nodes."""
    runs: dict[int, list[tuple]] = {}
    for batch in batches:  # in the order of runs and positions
        for run, seq, lcp, n, first in zip(*[batch.column(c).to_pylist() for c in ("run", "seq", "lcp", "n", "first")]):
            part = runs.setdefault(run, [])
            part.append((seq, lcp if part else 0, n, first))
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32())
    names = [c.split()[0] for c in NODES.split(", ")]
    made: list[list] = []
    to_batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], t) for k, t in enumerate(kinds)], names)
    for row in trie_rows(iter(LoserTree(list(runs.values()))), TaskContext.get().partitionId()):
        made.append(row)
        if len(made) == 10_000:
            yield to_batch()
            made.clear()
    if made:
        yield to_batch()


def hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) from (key, run, ids) in order: one hash at a time, fed as rows come."""
    now, state = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key == now:
                state.update(b"," + ids)
                continue
            if now is not None:
                done.append((now, state.hexdigest()))
            now, state = key, hashlib.sha256(ids)
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])


def joined_paths(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes on the paths of all ranges, put together, and the smallest member of each row of a path."""
    up = Window.partitionBy("part", "side").orderBy("depth")
    rows = paths.withColumn("parent", F.lag("key").over(up))
    nodes = rows.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("points").alias("points"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("ends").alias("ends"),
        F.min(F.struct("part", "side")).alias("owner"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    more = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    nodes = nodes.join(more.where("key IS NOT NULL"), "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    nodes = written(
        nodes.withColumn("own_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).withColumn("own_saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("points")), "trie-paths"
    )
    # A node's own sums stand on one of the paths it is on, and go up that path to all that it is below.
    held = rows.select("part", "side", "depth", "key").join(nodes.select("key", "conv_id", "owner", "own_leaves", "own_saved"), "key")
    here = F.col("owner") == F.struct("part", "side")
    below = Window.partitionBy("part", "side").orderBy(F.col("depth").desc())
    sums = [F.sum(F.when(here, F.col(c)).otherwise(F.lit(0))).over(below).alias(to) for c, to in (("own_leaves", "n_leaves"), ("own_saved", "saved"))]
    risen = held.select("key", *sums).groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.drop("n_leaves", "saved").join(risen, "key").join(parents, "parent", "left")
    return whole, held.select("part", "side", "depth", "conv_id")


def prefix_trie(conversations: DataFrame, bytes_per_task: int = 16_000_000) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = written(turn_tokens(conversations), "trie-turns")
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "token"]
    runs = written(turns.repartitionByRange(tasks, "base").sortWithinPartitions(*order).mapInArrow(sorted_runs, RUNS), "trie-runs")
    size = runs.agg(F.coalesce(F.sum(F.octet_length("seq") + 100), F.lit(0))).first()[0]
    entries = runs.drop("ids").repartitionByRange(max(tasks, size // bytes_per_task + 1), "seq").sortWithinPartitions("run", "pos")
    made = written(entries.mapInArrow(merge_runs, NODES), "trie-nodes")

    ids = runs.select(F.substring(F.unhex(F.sha2("seq", 256)), 1, 16).alias("key"), "run", "ids")
    hashes = ids.repartition(tasks, "key").sortWithinPartitions("key", "run").mapInArrow(hash_ids, "key binary, ends_sha256 string")

    on_paths, member = joined_paths(made.where("kind = 'path'"))
    inner = made.where("kind = 'node'")
    below = inner.where("parent_depth IS NOT NULL").drop("parent_conv_id")
    member = member.select("part", F.col("side").alias("parent_side"), F.col("depth").alias("parent_depth"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    nodes = inner.where("parent_depth IS NULL").select(*columns).unionByName(below.join(member, ["part", "parent_side", "parent_depth"]).select(*columns)).unionByName(on_paths.select(*columns))
    ended = nodes.where("ends").join(hashes, "key").unionByName(nodes.where("NOT ends").withColumn("ends_sha256", F.lit(NO_IDS)))
    long = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves")]
    return ended.select(*long, F.col("saved").cast("long").alias("saved_tokens"), "ends_sha256")
