"""Centroid clustering of vectors by exact integers, with Drake's adaptive bounds.

Of each vector are stored its cluster, an upper bound of the distance to it, lower bounds of the `b` nearest other
centroids, and one lower bound of all the rest. When centroids have moved, bounds move by as much. A vector whose upper
bound stays below every lower one keeps its cluster unseen; else its own distance is measured, then, if the rest is
still out of reach, those of the stored centroids; only where the order cannot be certified so, all of them. Distances
are of integers and exact, bounds are rounded away from certainty, and equal distances never certify, so the result is
that of comparing every vector with every centroid. `b` begins at a quarter of the centroids and falls, down to an
eighth, to what the last round made use of.

A round is one pass over the vectors and their bounds, written to the shared folder, and sums per cluster, added up in
each task first; a centroid table (k rows) is all that the driver holds.

Defined results: a vector counts that has exactly `size` components, none null or not finite, and none of 2**21 or more
in magnitude (64-bit distances could not hold those); ids may be null or repeat, each row is a vector of its own; a null
id is hashed as the empty text; rows of one hash are taken by id, then components; equal vectors share a cluster; fewer
vectors than centroids make so many centroids; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import ship, written

STATE = "vec_id long, x array<int>, cluster int, upper double, near array<int>, lower array<double>, rest double, work int, depth int"
#: What `work` says of a vector in a round.
CERTIFIED, TIGHTENED, REORDERED, RESCANNED = range(4)


def integer_vectors(embeddings: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(vec_id, x: int array): floor(scale * component) of the vectors that count."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            fits = np.array([n == size for n in vectors.value_lengths().to_pylist()], bool)
            some = batch.filter(pa.array(fits))
            values = some.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            good = (np.abs(values) < 2.0**21).all(axis=1)  # false for NaN, which nulls become
            whole = np.floor(values[good] * scale).astype(np.int32)
            yield pa.RecordBatch.from_arrays([some.column(0).filter(pa.array(good)), arrays(whole)], ["vec_id", "x"])

    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(work, "vec_id long, x array<int>")


def arrays(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(rows.reshape(-1)))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest SHA-256 of "seed:id"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.withColumn("digest", digest).orderBy("digest", "vec_id", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors (n, size) and, of each, some centroids (n, m, size) or all (m, size)."""
    if centroids.ndim == 2:
        return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None, :]
    return ((x[:, None, :] - centroids) ** 2).sum(2)


def scan(x: np.ndarray, centroids: np.ndarray, b: int) -> dict[str, np.ndarray]:
    """All distances: the nearest centroid, the b next with their distances, and that of the one after them."""
    d = squares(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")  # equal distances: smaller number first
    roots = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    rest = roots[:, b + 1] if d.shape[1] > b + 1 else np.full(len(x), np.inf)
    return {"cluster": order[:, 0], "upper": roots[:, 0], "near": order[:, 1 : b + 1], "lower": roots[:, 1 : b + 1], "rest": rest}


def assign(x: np.ndarray, old: dict[str, np.ndarray], centroids: np.ndarray, moves: np.ndarray, b: int) -> dict[str, np.ndarray]:
    """The state of vectors after centroids moved; old: the state before, with b or more stored centroids."""
    slack = 1e-9 * (1 + np.abs(x).max(initial=0) * x.shape[1])  # far above what rounding can add up to
    cluster, near = old["cluster"].copy(), old["near"]
    upper = old["upper"] + moves[cluster] + slack
    lower = old["lower"] - moves[near] - slack
    rest = old["rest"] - moves.max(initial=0) - slack
    rest = np.minimum(rest, lower[:, b:].min(axis=1, initial=np.inf))
    near, lower = near[:, :b].copy(), lower[:, :b].copy()
    least = np.minimum(lower.min(axis=1, initial=np.inf), rest)
    work, depth = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)

    open_ = np.flatnonzero(upper >= least)
    upper[open_] = np.sqrt(squares(x[open_], centroids[cluster[open_]][:, None, :])[:, 0].astype(np.float64)) + slack
    work[open_] = TIGHTENED
    open_ = open_[upper[open_] >= least[open_]]

    few = open_[upper[open_] < rest[open_]]  # none of the rest can be as near
    if len(few):
        work[few] = REORDERED
        depth[few] = (lower[few] <= upper[few, None]).sum(axis=1)
        ids = np.concatenate([cluster[few, None], near[few]], axis=1)
        ids.sort(axis=1)
        d = squares(x[few], centroids[ids])
        order = np.argsort(d, axis=1, kind="stable")
        ids, roots = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        cluster[few], upper[few], near[few], lower[few] = ids[:, 0], roots[:, 0], ids[:, 1:], roots[:, 1:]

    all_ = open_[upper[open_] >= rest[open_]]
    all_ = all_[work[all_] != REORDERED]
    if len(all_):
        work[all_], depth[all_] = RESCANNED, b
        new = scan(x[all_], centroids, b)
        cluster[all_], upper[all_], near[all_], lower[all_], rest[all_] = (new[c] for c in ("cluster", "upper", "near", "lower", "rest"))
    return {"cluster": cluster, "upper": upper, "near": near, "lower": lower, "rest": rest, "work": work, "depth": depth}


def one_pass(vectors: DataFrame, centroids: np.ndarray, moves: np.ndarray | None, stored: int, b: int, size: int) -> DataFrame:
    """The state after a round; moves: None before the first, when vectors have no state."""
    columns = ["vec_id", "x", "cluster", "upper", "near", "lower", "rest", "work", "depth"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), size).astype(np.int64)
            if moves is None:
                new = scan(x, centroids, b) | {"work": np.full(len(x), RESCANNED, np.int32), "depth": np.full(len(x), b, np.int32)}
            else:
                old = {c: batch.column(c).to_numpy() for c in ("cluster", "upper", "rest")}
                old |= {"near": matrix(batch.column("near"), stored) if stored else np.zeros((len(x), 0), int), "lower": matrix(batch.column("lower"), stored) if stored else np.zeros((len(x), 0))}
                new = assign(x, old, centroids, moves, b)
            made = [batch.column("vec_id"), batch.column("x"), pa.array(new["cluster"].astype(np.int32)), pa.array(new["upper"]), arrays(new["near"].astype(np.int32)), arrays(new["lower"]), pa.array(new["rest"]), pa.array(new["work"]), pa.array(new["depth"])]
            yield pa.RecordBatch.from_arrays(made, columns)

    return vectors.mapInArrow(work, STATE)


def moved(state: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """New centroids, floors of exact means, and the deepest stored bound that a vector made use of."""
    size = centroids.shape[1]
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), *[F.sum(F.col("x")[k].cast("long")).alias(f"s{k}") for k in range(size)])
    new, depth = centroids.copy(), 0
    for r in sums.collect():  # a row a centroid
        new[r["cluster"]] = [r[f"s{k}"] // r["n"] for k in range(size)]
        depth = max(depth, r["depth"])
    return new, depth


def cluster(
    embeddings: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, size: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """The state of every vector after `rounds` updates and a last assignment, and the final centroids."""
    ship(embeddings.sparkSession)
    vectors = written(integer_vectors(embeddings, id_col, vector_col, size, scale), "centroid-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return vectors.selectExpr("vec_id", "x", "0 AS cluster"), centroids
    k = len(centroids)
    stored = b = min(-(-k // 4), k - 1)
    state, moves = vectors, None
    for _ in range(rounds):
        state = written(one_pass(state, centroids, moves, stored, b, size), "centroid-state")
        new, depth = moved(state, centroids)
        moves = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64))
        centroids, stored = new, b
        b = min(b, max(k // 8, depth))
    return one_pass(state, centroids, moves, stored, b, size), centroids


def clusters(embeddings: DataFrame, **parameters) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    state, centroids = cluster(embeddings, **parameters)
    id_col = parameters.get("id_col", "vec_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column("cluster").to_numpy()
                d = squares(matrix(batch.column("x"), centroids.shape[1]).astype(np.int64), centroids[own][:, None, :])[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(d)], ["vec_id", "cluster", "distance"])

    measured = written(state.select("vec_id", "x", "cluster").mapInArrow(work, "vec_id long, cluster int, distance long"), "centroid-distances")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    per_cluster = measured.groupBy("cluster").agg(whole("distance").alias("own"))
    total = per_cluster.agg(F.sum("own").alias("inertia"))
    digests = [(n, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for n, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")  # a row a centroid, as are the sums
    sums = per_cluster.join(F.broadcast(named), "cluster").join(F.broadcast(total))
    return measured.join(F.broadcast(sums), "cluster").select(
        F.col("vec_id").alias(id_col), "cluster", "distance", F.col("own").try_cast("long").alias("cluster_inertia"), F.col("inertia").try_cast("long").alias("inertia"), "centroid_sha256"
    )
