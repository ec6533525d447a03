"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: words of the lower-cased (A-Z) text, shingles of `words` words, XXH64 with seed 42 of each, and a
bit for each position set in over half of them. Distinct fingerprints link at up to `most` differing bits, here
3: two that link agree on at least two of five bit blocks, so each is filed under the ten masked patterns of
two blocks, and every link shows in one of the files.

Within a file, fingerprints are sorted by Gray rank. Runs of neighbours form leaves, runs of leaves form upper
nodes; what bits all members share is factored out into their node, and a descent over pairs of nodes adds up
the differing shared bits on the way: a pair of nodes beyond the limit is cut off with all below it. Only
spanning links leave a file, not its pairs: as many as it has members at most.

A file of more than `file_rows` fingerprints is cut into chunks in Gray order. The chunks' shared bits rule out
pairs of chunks in the same way, and the pairs that remain are compared as rows of their own on all executors.
Rows of the same fingerprint are one node throughout; links, components and fingerprints stay in DataFrames.

`near_copies` is the wider form, for texts alike at a Jaccard similarity of `least` (0.8) or more on five-word
shingles. Its fingerprints are of the set of shingles, each counted once, as the similarity is: repeats of a line
move no bit. Such texts differ in about 39 of 256 fingerprint bits, too many for blocks that agree. So the 256 votes
behind the fingerprint are turned by fixed random signs and a Hadamard transform, and a text is filed, in each of
some tables, under the places and signs of the strongest turned votes of a few groups, and under those with the
second strongest in the two closest groups. Keys widen and tables become more with a count of the documents
(`file_plan`): texts that have nothing in common meet in a file `chance` times a text at most, however many there
are, and of pairs at 0.8 itself `recall` meet in some file; the share rises with the similarity, and in a group of
copies one link of several is enough. Texts of one shingle set are one node. Of each file neighbours in Gray order
are verified first: the shingle sets are compared whole. Texts that then still have one of another group within
`most` of 256 bits in some file form families by the files they share. A family is compared in one place, each member's
set with all others at once, and only links that join groups leave it, never its pairs.

Defined results: null text counts as empty; a text without words has fingerprint zero, linked like any other;
with fewer words than a shingle has, the whole sequence is the shingle; null ids are never the smallest;
repeated rows get the same result; an empty table gives an empty result; very long texts are hashed in blocks and
count whole; further columns may have any names but those that begin with two underscores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.common import keep_rows, row_key, ship, spread_join, text_mixes, text_or_empty, written
from tarnwatch.llm.components import stars

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCKS = (13, 13, 13, 13, 12)


def _masks() -> list[int]:
    at, blocks = 0, []
    for width in _BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [blocks[i] | blocks[j] for i in range(5) for j in range(i)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(text: str, words: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of each shingle of a text, in blocks."""
    from xxhash import xxh64_intdigest

    # bytes.split() without an argument splits at runs of exactly \x20 and \x09-\x0D.
    norm = b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())
    if not norm:
        return
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(norm)]))
    if len(starts) >= words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for i in range(0, len(starts), block):
        some = zip(starts[i : i + block].tolist(), ends[i : i + block].tolist(), strict=True)
        yield np.array([xxh64_intdigest(norm[s:e], 42) for s, e in some], np.uint64)


def _votes(h: np.ndarray, more: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(64 * (1 + len(more)), np.int64)
    mixed = [h]
    for factor in more:
        x = h * np.uint64(factor)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed.append(x ^ (x >> np.uint64(32)))
    for k, x in enumerate(mixed):
        bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        out[64 * k : 64 * k + 64] = 2 * bits.sum(axis=0, dtype=np.int64) - len(h)
    return out


def votes(text: str, words: int, more: tuple[int, ...] = ()) -> np.ndarray:
    """For each bit, the hashes that set it less those that don't; 64 bits, and 64 for each factor in `more`,
    by which the hashes are mixed anew. High bits come first. A shingle counts as often as it occurs."""
    return sum((_votes(h, more) for h in shingle_hashes(text, words)), np.zeros(64 * (1 + len(more)), np.int64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """The hashes of a text's shingles, each once, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def set_votes(shingles: np.ndarray, more: tuple[int, ...] = (), block: int = 1 << 16) -> np.ndarray:
    """As votes(), of a shingle_set()."""
    parts = (_votes(shingles[i : i + block], more) for i in range(0, len(shingles), block))
    return sum(parts, np.zeros(64 * (1 + len(more)), np.int64))


def fingerprint(text: str, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return int.from_bytes(np.packbits(votes(text, words) > 0).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """Per row: __id, __mix (a hash of the text) and __fp, the fingerprint as a signed long."""
    ship(docs.sparkSession)
    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__mix"), text.alias("__text"))
    kind = own.schema["__id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, words) for t in pdf["__text"]], np.uint64).view(np.int64)
            yield pdf[["__id", "__mix"]].assign(__fp=fp)

    return own.mapInPandas(work, f"__id {kind}, __mix bigint, __fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the Gray sequence."""
    r = codes.copy()
    for by in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(by)
    return r


def gray_rank_column(fp: Column) -> Column:
    """As gray_rank(), in an order that signed comparison keeps."""
    r = fp
    for by in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, by))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Fingerprints of one or more 64-bit words (n x words) in Gray order of the first, under nodes that hold
    what bits all below them share."""

    def __init__(self, codes: np.ndarray, fan: int = 8):
        self.order = np.argsort(gray_rank(codes[:, 0]), kind="stable")
        self.codes, self.fan = codes[self.order], fan
        # levels[0]: the codes themselves; each level above: (shared bit mask, their values)
        self.levels = [(np.full_like(self.codes, ~np.uint64(0)), self.codes)]
        ones, any_ = self.codes, self.codes
        while len(ones) > fan:
            at = np.arange(0, len(ones), fan)
            ones, any_ = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(any_, at)
            self.levels.append((ones | ~any_, ones))

    def links(self, other: GrayIndex | None = None, most: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions (in Gray order) of all pairs at most `most` bits apart, of this and the other index, and how far."""
        same, other = other is None, other or self
        top = min(len(self.levels), len(other.levels)) - 1
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(self.levels[top][0])), np.arange(len(other.levels[top][0])), indexing="ij"))
        known = np.zeros((len(i), self.codes.shape[1]), np.uint64)
        apart = np.zeros(len(i), np.int64)
        step = np.arange(self.fan)
        for level in range(top, -1, -1):
            shared, value = self.levels[level]
            shared2, value2 = other.levels[level]
            if level < top:
                i = (i[:, None] * self.fan + np.repeat(step, self.fan)[None, :]).ravel()
                j = (j[:, None] * self.fan + np.tile(step, self.fan)[None, :]).ravel()
                known, apart = np.repeat(known, self.fan**2, axis=0), np.repeat(apart, self.fan**2)
            ok = (i < len(value)) & (j < len(value2))
            if same:
                ok &= (i <= j) if level else (i < j)
            i, j, known, apart = i[ok], j[ok], known[ok], apart[ok]
            both = shared[i] & shared2[j]
            apart = apart + np.bitwise_count((value[i] ^ value2[j]) & both & ~known).sum(axis=1, dtype=np.int64)
            ok = apart <= most
            i, j, known, apart = i[ok], j[ok], both[ok], apart[ok]
        return i, j, apart


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position each of n positions is joined with by the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def forest(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) join the n positions by the closest links."""
    label, pair, taken = np.arange(n), np.arange(len(i)), []
    while True:
        open_ = label[i] != label[j]
        i, j, apart, pair = i[open_], j[open_], apart[open_], pair[open_]
        if not len(i):
            return np.concatenate(taken) if taken else pair
        # Ties go by the pair's number, so the choice has no cycles.
        end = np.concatenate((label[i], label[j]))
        which = np.tile(np.arange(len(i)), 2)
        order = np.lexsort((which, apart[which], end))
        first = np.unique(which[order][np.flatnonzero(np.diff(end[order], prepend=-1))])
        taken.append(pair[first])
        label = spanning(n, label[i[first]], label[j[first]])[label]


def _spanning_links(names: list[np.ndarray], codes: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span one file, or two chunks of one: names and codes have one entry or two."""
    x = GrayIndex(codes[0])
    name = names[0][x.order]
    if len(codes) == 1:
        i, j, apart = x.links(most=most)
    else:
        y = GrayIndex(codes[1])
        i, j, apart = x.links(y, most)
        j, name = j + len(name), np.concatenate((name, names[1][y.order]))
    use = forest(len(name), i, j, apart)
    return name[i[use]], name[j[use]]


def _join_lists(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """columns: one or two lists of (name, word...) structs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables, ends = [], []
            for c in columns:
                lists = batch.column(c)
                fields = lists.flatten().flatten()
                tables.append(np.stack([f.to_numpy(zero_copy_only=False) for f in fields], axis=1))
                ends.append(np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))))
            todo, out = range(batch.num_rows), []
            if len(columns) == 1:
                # Files of two are one pair each, compared all at once; an index would have nothing to rule out.
                size = np.diff(ends[0])
                two = ends[0][:-1][size == 2]
                x, y = tables[0][two], tables[0][two + 1]
                near = np.bitwise_count((x[:, 1:] ^ y[:, 1:]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most
                out.append((x[near, 0], y[near, 0]))
                todo = np.flatnonzero(size > 2).tolist()
            for k in todo:
                some = [t[e[k] : e[k + 1]] for t, e in zip(tables, ends, strict=True)]
                out.append(_spanning_links([t[:, 0] for t in some], [t[:, 1:].view(np.uint64) for t in some], most))
            if out:
                a, b = (np.concatenate([o[n] for o in out]) for n in (0, 1))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select(*columns).mapInArrow(work, "a bigint, b bigint")


def file_links(filed: DataFrame, nodes: DataFrame, words: list[str], most: int, file_rows: int, chunk_rows: int) -> DataFrame:
    """filed (file, name), nodes (name, *words) to links (a, b) that span, file by file, the pairs at most
    `most` bits apart."""
    sizes = written(filed.groupBy("file").agg(F.count("*").alias("n")).where("n > 1"), "file-sizes")
    entry = F.struct("name", *words)
    small = filed.join(sizes.where(F.col("n") <= file_rows), "file").select("file", "name").join(nodes, "name")
    found = _join_lists(small.groupBy("file").agg(F.collect_list(entry).alias("x")), ["x"], most)
    crowded = sizes.where(F.col("n") > file_rows)
    total = crowded.agg(F.sum("n")).first()[0]
    if not total:
        return found.distinct()
    # Crowded files are cut up in Gray order.
    large = filed.join(crowded.select("file"), "file").join(nodes, "name")
    ordered = large.repartitionByRange(int(total // chunk_rows + 1), "file", gray_rank_column(F.col(words[0])))
    cut = written(ordered.withColumn("chunk", F.spark_partition_id()), "file-chunks")
    bounds = [f(w).alias(f"{n}_{w}") for w in words for n, f in (("ones", F.bit_and), ("any", F.bit_or))]
    chunks = written(cut.groupBy("file", "chunk").agg(F.collect_list(entry).alias("x"), *bounds), "chunk-lists")

    def side(at: str) -> DataFrame:
        return chunks.select("file", *[F.col(c).alias(f"{at}_{c}") for c in chunks.columns if c not in ("file", "x")])

    def sure(w: str, one: str, other: str):
        return F.col(f"{one}_ones_{w}").bitwiseAND(F.bitwise_not(F.col(f"{other}_any_{w}")))

    apart = sum((F.bit_count(sure(w, "l", "r").bitwiseOR(sure(w, "r", "l"))) for w in words), F.lit(0))
    pairs = side("l").join(side("r"), "file").where((F.col("l_chunk") < F.col("r_chunk")) & (apart <= most))
    met = pairs.select("file", "l_chunk", "r_chunk")
    for at, x in (("l", "x"), ("r", "y")):
        met = met.join(chunks.select("file", F.col("chunk").alias(f"{at}_chunk"), F.col("x").alias(x)), ["file", f"{at}_chunk"])
    return found.unionByName(_join_lists(chunks, ["x"], most)).unionByName(_join_lists(met, ["x", "y"], most)).distinct()


def neighbour_pairs(shared: DataFrame, words: list[str], most: int, least: float) -> DataFrame:
    """shared (file, name, size, *words) to pairs (a, b) of neighbours in Gray order, file by file, at most `most`
    bits apart: no more than rows, however crowded a file is."""
    order = ["file", gray_rank_column(F.col(words[0])), "name"]
    laid = shared.repartitionByRange(*order).sortWithinPartitions(*order).select("file", "name", "size", *words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros((0, 3 + len(words)), np.int64)
        for batch in batches:
            t = np.concatenate((last, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)))
            last, x, y = t[-1:], t[:-1], t[1:]
            near = np.bitwise_count((x[:, 3:] ^ y[:, 3:]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most
            near &= (x[:, 0] == y[:, 0]) & _sizes_allow(x[:, 2], y[:, 2], least)
            yield _pair_batch(x[near, 1], y[near, 1])

    return laid.mapInArrow(work, "a bigint, b bigint").distinct()


def _sizes_allow(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Sets of n and of m members can have a similarity of `least`."""
    return np.minimum(n, m) >= least * np.maximum(n, m)


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def open_names(shared: DataFrame, labels: DataFrame, words: list[str], most: int, least: float, file_rows: int) -> DataFrame:
    """shared (file, name, size, *words), labels (name, label) to the names, with label and size, that may have a
    partner of another label: one at most `most` bits apart, and of fitting size, in some file. In a file of more than
    file_rows names all may, if it has two labels. No pair leaves a file, only names do."""
    labelled = written(shared.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name")), "labelled")
    sizes = labelled.groupBy("file").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    sizes = written(sizes.where("lo != hi").select("file", "n"), "open-files")
    entry = F.struct("name", "label", "size", *words)
    lists = labelled.join(sizes.where(F.col("n") <= file_rows).select("file"), "file").groupBy("file").agg(F.collect_list(entry).alias("x"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            t = np.stack([f.to_numpy(zero_copy_only=False) for f in column.flatten().flatten()], axis=1)
            ends = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
            open_ = np.zeros(len(t), bool)
            for k in range(batch.num_rows):
                x = t[ends[k] : ends[k + 1]]
                step = max(1, (1 << 18) // len(x))  # what is held at once does not grow with the list
                for at in range(0, len(x), step):
                    top = x[at : at + step]
                    i, j = np.nonzero((top[:, None, 1] != x[None, :, 1]) & _sizes_allow(top[:, None, 2], x[None, :, 2], least))
                    near = np.bitwise_count((top[i, 3:] ^ x[j, 3:]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= most
                    open_[ends[k] + at + i[near]] = True
            found = np.unique(t[open_, :3], axis=0)
            yield pa.RecordBatch.from_pydict({n: pa.array(found[:, c], pa.int64()) for c, n in enumerate(("name", "label", "size"))})

    small = lists.mapInArrow(work, "name bigint, label bigint, size bigint")
    crowded = labelled.join(sizes.where(F.col("n") > file_rows).select("file"), "file").select("name", "label", "size")
    return small.unionByName(crowded).distinct()


def _links_in_lists(rows: DataFrame, columns: list[str], least: float) -> DataFrame:
    """columns: one or two lists of (name, label, shingles) structs. Links (a, b) of a similarity of `least` or more that
    span the labels: inside one list, from all names not of its commonest label, or from one list to the other.

    A name's shingles are marked among those of the list, and one sum over all the list's shingles gives what it
    shares with every member; no pair is made. Only links leave, fewer than there are names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for k in range(batch.num_rows):
                parts = [batch.column(c).slice(k, 1).flatten().flatten() for c in columns]
                name, label = (np.concatenate([p[f].to_numpy(zero_copy_only=False) for p in parts]) for f in (0, 1))
                sizes = np.concatenate([p[2].value_lengths().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
                inverse = np.unique(np.concatenate([p[2].flatten().to_numpy(zero_copy_only=False) for p in parts]), return_inverse=True)[1]
                starts, ids = np.cumsum(sizes) - sizes, np.unique(label, return_inverse=True)[1]
                if len(columns) == 1:
                    seekers = np.flatnonzero(ids != np.bincount(ids).argmax())
                else:
                    seekers = np.arange(len(parts[0][0]))
                root, mark = np.arange(ids.max() + 1), np.zeros(inverse.max() + 1, np.int32)
                for x in seekers.tolist():
                    own = inverse[starts[x] : starts[x] + sizes[x]]
                    mark[own] = 1
                    same = np.add.reduceat(mark[inverse], starts)
                    mark[own] = 0
                    for y in np.flatnonzero((same >= least * (sizes[x] + sizes - same)) & (root[ids] != root[ids[x]])).tolist():
                        if (old := root[ids[y]]) != (new := root[ids[x]]):
                            root[root == old] = new
                            a.append(name[x])
                            b.append(name[y])
            yield _pair_batch(np.array(a, np.int64), np.array(b, np.int64))

    return rows.select(*columns).mapInArrow(work, "a bigint, b bigint")


def rare_families(sets: DataFrame, least: float) -> DataFrame:
    """sets (family, name, label, shingles) to smaller families that lose no pair alike at `least` or more.

    Of n shingles two such sets share so many that one is among the n - ceil(least * n) + 1 that are rarest in the family,
    ties by value, of either. Sets that have one of their rarest in common make a family; those of one label go."""
    size = F.size("shingles")
    each = sets.select("family", "name", "label", size.alias("n"), F.explode("shingles").alias("s")).withColumn("k", F.xxhash64("family", "s"))
    seen = written(each.groupBy("k").agg(F.count("*").alias("__n")).withColumn("seen", F.col("__n")), "shingle-counts")
    rarest = Window.partitionBy("family", "name").orderBy("seen", "s")
    few = spread_join(each, seen, "k").withColumn("at", F.row_number().over(rarest)).where(F.col("at") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    rare = written(few.select("k", "name", "label"), "rare-shingles")
    shared = rare.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("k")
    return written(rare.join(shared, "k").join(sets.select("name", "shingles"), "name").select(F.col("k").alias("family"), "name", "label", "shingles"), "rare-families")


def family_links(sets: DataFrame, least: float, most_work: float = 2e9) -> DataFrame:
    """sets (family, name, label, shingles) to links that span, family by family, all pairs of different labels alike at
    `least` or more.

    A family's work is its names times its shingles. Up to most_work a family is compared whole; a larger one becomes
    families of those that share one of their rarest shingles, and only what is still larger is cut up."""
    work = F.count("*").cast("double") * F.sum(F.size("shingles"))
    sizes = written(sets.groupBy("family").agg(work.alias("work"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi"), "family-work")
    if sizes.where(F.col("work") > most_work).isEmpty():
        return compared_whole(sets, least, most_work)
    small = sets.join(sizes.where(F.col("work") <= most_work).select("family"), "family")
    large = sets.join(sizes.where(F.col("work") > most_work).select("family"), "family")
    return compared_whole(small, least, most_work).unionByName(compared_whole(rare_families(large, least), least, most_work))


def compared_whole(sets: DataFrame, least: float, most_work: float) -> DataFrame:
    """family_links by comparison: a family beyond most_work is cut into chunks by label and name, and each chunk meets each
    other that has another label as a row of its own, on all executors."""
    n = F.size("shingles")
    sizes = written(sets.groupBy("family").agg(F.count("*").alias("n"), F.sum(n).alias("of"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi"), "families")
    work = F.col("n").cast("double") * F.col("of")
    entry = F.collect_list(F.struct("name", "label", "shingles")).alias("x")
    small = sets.join(sizes.where(work <= most_work).select("family"), "family").groupBy("family").agg(entry)
    found = _links_in_lists(small, ["x"], least)
    large = sizes.where(work > most_work)
    parts = large.agg(F.sum(F.ceil(F.sqrt(work / (most_work / 4))))).first()[0]
    if not parts:
        return found
    # The name is in the key, so rows of one label can be cut apart.
    dealt = sets.join(large.select("family"), "family").repartitionByRange(int(parts), "family", "label", "name")
    cut = written(dealt.withColumn("chunk", F.spark_partition_id()), "family-chunks")
    chunks = written(cut.groupBy("family", "chunk").agg(entry, F.min("label").alias("lo"), F.max("label").alias("hi")), "chunk-lists")

    def side(at: str) -> DataFrame:
        return chunks.select("family", *[F.col(c).alias(f"{at}_{c}") for c in ("chunk", "lo", "hi")])

    differ = F.least("l_lo", "r_lo") != F.greatest("l_hi", "r_hi")
    met = side("l").join(side("r"), "family").where((F.col("l_chunk") < F.col("r_chunk")) & differ).select("family", "l_chunk", "r_chunk")
    for at, c in (("l", "x"), ("r", "y")):
        met = met.join(chunks.select("family", F.col("chunk").alias(f"{at}_chunk"), F.col("x").alias(c)), ["family", f"{at}_chunk"])
    inner = _links_in_lists(chunks.where("lo != hi"), ["x"], least)
    return found.unionByName(inner).unionByName(_links_in_lists(met, ["x", "y"], least))


def links(nodes: DataFrame, most: int = 3, file_rows: int = 2000, chunk_rows: int = 1000) -> DataFrame:
    """nodes (__fp, distinct) to links (a, b) that span the same components as all pairs at most `most` apart.

    `most` is at most 3: five blocks, of which two must be alike."""
    assert 0 <= most <= 3
    blocks = F.array(*[F.xxhash64(F.lit(t), F.col("__fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(_masks())])
    named = nodes.select(F.col("__fp").alias("name"), F.col("__fp").alias("w0"))
    return file_links(nodes.select(F.col("__fp").alias("name"), F.explode(blocks).alias("file")), named, ["w0"], most, file_rows, chunk_rows)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = 3, file_rows: int = 2000
) -> DataFrame:
    """Per row: id, fingerprint, component_id (the smallest id reachable), text_mix and first_mix.

    (component_id, first_mix) names the one document of a component that stays when near copies are dropped."""
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    first = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__mix").alias("mix")))
    nodes = written(rows.groupBy("__fp").agg(F.count("*").alias("__n"), first.alias("first")), "nodes")
    star = stars(links(nodes.select("__fp"), most, file_rows))
    rooted = nodes.join(star, F.col("__fp") == F.col("a"), "left").withColumn("root", F.coalesce("b", "__fp"))
    rooted = written(rooted.select("__fp", "__n", "first", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    named = rooted.join(least, "root").select(
        "__fp", "__n", F.col("least.id").alias("least_id"), F.col("least.mix").alias("least_mix")
    )
    return spread_join(rows, named, "__fp").select(
        F.col("__id").alias(id_col),
        F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"),
        F.col("least_id").alias("component_id"),
        F.col("__mix").alias("text_mix"),
        F.col("least_mix").alias("first_mix"),
    )


#: Odd 64-bit numbers that mix a hash anew; they may be any.
_MORE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def file_plan(texts: int, recall: float = 0.985, chance: float = 0.25) -> tuple[int, int]:
    """(bits of a key, tables) for so many texts.

    The share of pairs at a similarity of 0.8 that meet in one table is measured (tests/llm): above 0.32 at 24 bits,
    and falling by some 8 % a bit. A table's four keys of one text and four of another make 16 chances in
    2**bits; n texts make n/2 pairs a text, and each pair is two rows."""
    bits = 12
    while True:
        tables = math.ceil(math.log(1 - recall) / math.log(1 - min(0.55, 0.32 * 0.915 ** (bits - 24))))
        if texts * tables * 16 <= chance * 2**bits:
            return bits, tables
        bits += 1


@lru_cache(maxsize=4)
def _signs(turns: int) -> np.ndarray:
    """Fixed random signs of 256 votes for each turn, alike on all executors."""
    return np.random.default_rng(64).choice(np.array([-1, 1], np.float32), (turns, 256))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the last axis."""
    half = 1
    while half < x.shape[-1]:
        y = x.reshape(*x.shape[:-1], -1, 2, half)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(x.shape)
        half *= 2
    return x


def file_keys(v: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The files of texts with votes v (texts x 256): four a table."""
    groups = -(-bits // 10)
    widths = [bits // groups + (k < bits % groups) for k in range(groups)]
    turns = -(-sum(1 << (w - 1) for w in widths) // 256)
    signs, rows = _signs(turns * tables), np.arange(len(v))
    v, out = v.astype(np.float32), []
    for t in range(tables):
        turned = _hadamard(v[:, None, :] * signs[None, t * turns : (t + 1) * turns]).reshape(len(v), -1)
        key, at, shift, gaps, other = np.full(len(v), t << bits), 0, 0, [], []
        for w in widths:
            own = turned[:, at : at + (1 << (w - 1))]
            size = np.abs(own)
            i = size.argmax(axis=1)
            top = size[rows, i]
            size[rows, i] = -1
            j = size.argmax(axis=1)
            first, second = 2 * i + (own[rows, i] > 0), 2 * j + (own[rows, j] > 0)
            key |= first << shift
            gaps.append(top - size[rows, j])
            other.append((first ^ second) << shift)
            at, shift = at + (1 << (w - 1)), shift + w
        close = np.argsort(np.stack(gaps, axis=1), axis=1, kind="stable")[:, :2]
        turn = np.take_along_axis(np.stack(other, axis=1), close, axis=1)
        out += [key, key ^ turn[:, 0], key ^ turn[:, 1], key ^ turn[:, 0] ^ turn[:, 1]]
    return np.stack(out, axis=1)


def name_nodes(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows (name, name2, ...) and one node per set of shingles, with what the columns hold. Where two sets have one
    name, which second hashes tell, all but one of them take those for a name."""
    first = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), "mix", "mix2"))
    while True:
        one = rows.groupBy("name").agg(
            F.count("*").alias("__n"), first.alias("first"), F.min("name2").alias("lo"), F.max("name2").alias("hi"), *[F.first(c).alias(c) for c in columns]
        )
        nodes = written(one, "nodes")
        clash = nodes.where("lo != hi").select("name", "lo")
        if clash.isEmpty():
            return rows, nodes.drop("lo", "hi")
        parted = rows.join(clash, "name", "left").withColumn("name", F.when(F.col("name2") != F.col("lo"), F.col("name2")).otherwise(F.col("name")))
        rows = written(parted.drop("lo"), "sketches")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, most: int = 56,
    plan: tuple[int, int] | None = None, file_rows: int = 2000, broadcast_rows: int = 200_000,
) -> DataFrame:
    """Per row: id, component_id (the smallest id of its group of near copies), text_mix and first_mix.

    `plan` is (bits of a key, tables); None: as file_plan() has it for the rows of docs."""
    ship(docs.sparkSession)
    text = text_or_empty(text_col)
    own = docs.select(F.col(id_col).alias("__id"), *text_mixes(text), text.alias("__text"))
    kind = own.schema["__id"].dataType.simpleString()
    columns = ["w0", "w1", "w2", "w3"]
    bits, tables = plan or file_plan(docs.count())

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for pdf in batches:
            v, names, others, sizes = [], [], [], []
            for t in pdf["__text"]:
                h = shingle_set(t, words)
                v.append(set_votes(h, _MORE))
                names.append(_signed(xxh64_intdigest(h.tobytes())))
                others.append(_signed(xxh64_intdigest(h.tobytes(), 1)))
                sizes.append(len(h))
            v = np.array(v).reshape(len(v), 256)
            codes = np.packbits(v > 0, axis=1).view(">i8").astype(np.int64)
            out = pdf[["__id", "mix", "mix2"]].assign(name=np.array(names, np.int64), name2=np.array(others, np.int64), size=np.array(sizes, np.int64))
            out = out.assign(**{c: codes[:, k] for k, c in enumerate(columns)})
            yield out.assign(files=list(file_keys(v, bits, tables)))

    schema = f"__id {kind}, mix bigint, mix2 bigint, name bigint, name2 bigint, size bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint, files array<bigint>"
    # A node is a set of shingles: texts that differ in case, white space or repeats are one, with no pair compared.
    rows, nodes = name_nodes(written(own.mapInPandas(sketch, schema), "sketches"), ["size", *columns, "files"])
    filed = nodes.select("name", F.explode("files").alias("file"))
    full = written(filed.groupBy("file").agg(F.count("*").alias("n")).where("n > 1").select("file"), "file-sizes")
    shared = written(filed.join(full, "file").join(nodes.select("name", "size", *columns), "name"), "shared-files")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "shingles": [shingle_set(t, words).view(np.int64) for t in pdf["__text"]]})

    def sets_of(names: DataFrame) -> DataFrame:
        """The shingle sets of so many names, by one text of each; no other text is read into sets."""
        wanted = written(names.join(nodes.select("name", F.col("first.mix").alias("mix"), F.col("first.mix2").alias("mix2")), "name"), "near-names")
        few = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows
        some = own.select("mix", "mix2", "__text").join(F.broadcast(wanted) if few else wanted, ["mix", "mix2"]).select("name", "__text")
        return written(some.mapInPandas(sets, "name bigint, shingles array<bigint>").dropDuplicates(["name"]), "near-sets")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(same >= least * (len(x) + len(y) - same))
            yield pdf.loc[ok, ["a", "b"]]

    def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
        """Of the pairs those alike, by their shingle sets."""
        met = pairs.join(shingles.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a")
        met = met.join(shingles.select(F.col("name").alias("b"), F.col("shingles").alias("y")), "b")
        return met.mapInPandas(verify, "a bigint, b bigint")

    # First neighbours are verified, which joins most of each group of copies by few pairs. Names that may have further
    # partners make families, by the files they share, and each family is compared whole: none is lost to a closer
    # one that fails.
    near = written(neighbour_pairs(shared, columns, most, least), "near-pairs")
    star = stars(verified(near, sets_of(near.select(F.explode(F.array("a", "b")).alias("name")).distinct())))
    names = written(open_names(shared, star.select(F.col("a").alias("name"), F.col("b").alias("label")), columns, most, least, file_rows), "open-names")
    if not names.isEmpty():
        meet = shared.join(names.select("name"), "name").select("file", "name")
        families = stars(meet.join(meet.groupBy("file").agg(F.min("name").alias("b")), "file").select(F.col("name").alias("a"), "b"))
        family = names.join(families, F.col("name") == F.col("a"), "left").select("name", "label", F.coalesce("b", "name").alias("family"))
        star = stars(star.unionByName(family_links(sets_of(names.select("name")).where(F.size("shingles") > 0).join(family, "name"), least)))
    rooted = nodes.select("name", "__n", "first").join(star, F.col("name") == F.col("a"), "left")
    rooted = written(rooted.select("name", "__n", "first", F.coalesce("b", "name").alias("root")), "rooted")
    low = rooted.groupBy("root").agg(F.min("first").alias("low"))
    named = rooted.join(low, "root").select("name", "__n", F.col("low.id").alias("least_id"), F.struct("low.mix", "low.mix2").alias("least_mix"))
    return spread_join(rows.select("__id", "mix", "mix2", "name"), named, "name").select(
        F.col("__id").alias(id_col),
        F.col("least_id").alias("component_id"),
        F.struct("mix", "mix2").alias("text_mix"),
        F.col("least_mix").alias("first_mix"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each group of near copies, whole rows."""
    found = near_copies(docs, id_col, text_col, **how)
    stays = found.where(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("text_mix") == F.col("first_mix")))
    kept = stays.select(row_key(id_col, F.col("text_mix.mix"), F.col("text_mix.mix2")).alias("__key"))
    return keep_rows(docs, row_key(id_col, *text_mixes(text_or_empty(text_col))), kept)
