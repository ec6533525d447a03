"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and their beginnings of three to six characters. From a bounded sample of labelled
rows (`examples`, those of the smallest hashes of their ids) the terms that go with the label are kept: of the
`terms` strongest by log-likelihood ratio, those beyond what chance gives among so many candidates (terms that speak
against the label are not kept: a large group of alike clean texts would fill the vectors with its words); and pairs of
the `crossed` strongest in one text, a term with itself included, where the pair says more than either term, since
some words mark a text only together or repeated. Examples and texts are TF-IDF vectors of those.

The index keeps for each term and each block of examples the largest weight in it. A text's weights times those
bound the cosine of all examples of a block; blocks are read in falling order of the bound until it drops below
the k-th best cosine found, so the k nearest are exact. Their votes, weighted by cosine and drawn to the base
rate, are calibrated by isotonic regression on the examples themselves, each left out of its own vote. The
nearest examples come along as evidence.

Defined results: null text counts as empty; a text without known terms has no neighbours and gets the
calibrated score of such examples; without any labelled row, or with rows of one label only, every score is the
base rate (0 without rows); labels that contradict each other count as toxic, null labels as none; repeated rows
score alike, and of rows that share an id only the one of the smallest text is an example; equal cosines count by the
examples' order; very long texts are read whole; an empty table gives an empty result; other columns of the input are not
touched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import one_row_each, ship, text_or_empty

_WORD = re.compile(r"\w+")
_BEGINNINGS = (3, 4, 5, 6)


def terms_of(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in _BEGINNINGS if len(word) > n]]


def words_of(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


class Vectors:
    """Texts to sparse TF-IDF vectors of unit length over chosen terms."""

    def __init__(self, idf: dict[str, float], memo: int = 100_000):
        self.place = {t: i for i, t in enumerate(idf) if "&" not in t}
        #: A word that begins like none of the terms has none; most words are settled by that.
        self.heads = {t[:3] for t in self.place}
        self.pairs: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(idf):
            if "&" in t:
                a, b = (self.place[x] for x in t.split("&"))
                self.pairs.setdefault(a, []).append((b, i))
        self.idf = np.array(list(idf.values()), np.float64)
        self.memo: dict[str, list[int]] = {}
        self.most = memo

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts: dict[int, int] = {}
        memo, place, heads = self.memo, self.place, self.heads
        if len(memo) > self.most:
            memo.clear()
        for w, n in words_of(text).items():
            if w[:3] not in heads:
                continue
            at = memo.get(w)
            if at is None:
                at = memo[w] = [place[t] for t in terms_of(w) if t in place]
            for i in at:
                counts[i] = counts.get(i, 0) + n
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0)
        for a in [a for a in counts if a in self.pairs]:
            for b, i in self.pairs[a]:
                if n := (counts[a] // 2 if a == b else min(counts[a], counts.get(b, 0))):
                    counts[i] = n
        i = np.array(sorted(counts), np.int64)
        v = (1 + np.log([counts[k] for k in i.tolist()])) * self.idf[i]
        return i, v / np.sqrt((v * v).sum())


class BlockMaxIndex:
    """Unit vectors, in blocks, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = 64):
        # Examples with the same leading term stand together, which sharpens the bounds.
        lead = [int(i[np.argmax(v)]) if len(i) else terms for i, v in vectors]
        self.order = np.argsort(lead, kind="stable")
        self.block = block
        self.blocks = -(-len(vectors) // block)
        self.most = np.zeros((terms, self.blocks))
        #: Per block the row of each term it has (else -1), and the rows: weights in its examples.
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []
        for b in range(self.blocks):
            own = self.order[b * block : (b + 1) * block]
            here = np.unique(np.concatenate([vectors[n][0] for n in own]))
            weights = np.zeros((len(here), len(own)))
            for at, n in enumerate(own):
                weights[np.searchsorted(here, vectors[n][0]), at] = vectors[n][1]
            place = np.full(terms, -1, np.int32)
            place[here] = np.arange(len(here))
            self.postings.append((place, weights))
            self.most[here, b] = weights.max(axis=1)

    def nearest(self, i: np.ndarray, v: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above zero, ties by their number; `leave` is left out."""
        if not len(i):
            return np.zeros(0, np.int64), np.zeros(0)
        bound = v @ self.most[i]
        n, s, floor = np.zeros(0, np.int64), np.zeros(0), 0.0
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or bound[b] < floor - 1e-12:
                break
            place, weights = self.postings[b]
            row = place[i]
            has = row >= 0
            # Rounded, so that equal examples in different blocks tie.
            score = np.round(v[has] @ weights[row[has]], 12)
            at = np.flatnonzero((score > 0) & (score >= floor))
            names = self.order[b * self.block + at]
            use = names != leave
            n, s = np.concatenate((n, names[use])), np.concatenate((s, score[at][use]))
            if len(n) > k:
                best = np.lexsort((n, -s))[:k]
                n, s = n[best], s[best]
            if len(n) == k:
                floor = s.min()
        best = np.lexsort((n, -s))
        return n[best], s[best]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function of least squares, each level drawn to the middle by one vote each way."""
    at = np.unique(x)
    where = np.searchsorted(at, x)
    n, s = np.bincount(where).astype(float), np.bincount(where, weights=y)
    levels: list[list[float]] = []
    for k in range(len(at)):
        levels.append([s[k], n[k], k])
        while len(levels) > 1 and levels[-2][0] * levels[-1][1] >= levels[-1][0] * levels[-2][1]:
            a, m, k0 = levels.pop()
            levels[-1] = [levels[-1][0] + a, levels[-1][1] + m, k0]
    value, begin = np.zeros(len(at)), 0
    for a, m, last in levels:
        value[begin : int(last) + 1] = (a + 0.5) / (m + 1)
        begin = int(last) + 1
    return at, np.maximum.accumulate(value)


class Model:
    def __init__(self, idf: dict[str, float], vectors: list, labels: np.ndarray, names: list, k: int, pull: float = 0.5):
        self.vector, self.labels, self.names, self.k, self.pull = Vectors(idf), labels, names, k, pull
        self.base = float(labels.mean()) if len(labels) else 0.0
        self.index = BlockMaxIndex(vectors, max(1, len(idf))) if len(labels) else None
        self.knots = None
        if self.index and 0 < labels.sum() < len(labels):
            raw = np.array([self.vote(*self.index.nearest(*v, k, leave=n)) for n, v in enumerate(vectors)])
            self.knots = isotonic(raw, labels)

    def vote(self, n: np.ndarray, s: np.ndarray) -> float:
        return round(float(((s * self.labels[n]).sum() + self.pull * self.base) / (s.sum() + self.pull)), 6)

    def score(self, text: str) -> tuple[float, str]:
        if self.knots is None:
            return self.base, ""
        n, s = self.index.nearest(*self.vector(text), self.k)
        p = float(np.interp(self.vote(n, s), *self.knots))
        shown = [f"{self.names[a]}:{int(self.labels[a])}:{b:.3f}" for a, b in zip(n[:3].tolist(), s[:3].tolist(), strict=True)]
        return min(max(p, 0.0), 1.0), ",".join(shown)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learn, examples: int) -> DataFrame:
    """The bounded sample: __id, __text, __label of rows that `learn` (a condition on labels) lets in."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn)
    marked = marked.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label"))
    ids = docs.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()
    few = marked.join(ids, "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(examples)
    text = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    # few has at most `examples` rows of two numbers; so many rows come of the join.
    return one_row_each(text.join(F.broadcast(few), "__id"), ["__id"], ["__label", "__text"])


def fit(
    docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    examples: int = 8000, terms: int = 2048, crossed: int = 96, k: int = 25,
) -> Model:
    ship(docs.sparkSession)
    rows = sample(docs, labels, id_col, text_col, label_col, learn, examples).persist()
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("__label"), F.lit(0))).first()
    if not n or not 0 < positive < n:
        rows.unpersist()
        return Model({}, [(np.zeros(0, np.int64), np.zeros(0))] * n, np.full(n, positive / n if n else 0.0), [None] * n, k)

    def counted(parts_of) -> DataFrame:
        """(term, n, p): texts that have it, and those of them with the label."""

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen, hit = Counter(), Counter()
            for pdf in batches:
                for text, label in zip(pdf["__text"], pdf["__label"], strict=True):
                    own = parts_of(text)
                    seen.update(own)
                    if label:
                        hit.update(own)
            names = list(seen)
            for at in range(0, len(names), 20_000):
                some = names[at : at + 20_000]
                yield pd.DataFrame({"term": pd.Series(some, dtype=object), "n": [seen[t] for t in some], "p": [hit[t] for t in some]})

        found = rows.mapInPandas(count, "term string, n bigint, p bigint").groupBy("term")
        return found.agg(F.sum("n").alias("n"), F.sum("p").alias("p")).where(f"n >= 3 AND n < {n}")

    def strongest(found: DataFrame) -> list:
        """(term, n, ratio), at most `terms` of them, the strongest first."""
        found = found.persist()

        def part(x, of, whole):  # x * log(x / expected), 0 where x is 0
            return F.when(x > 0, x * F.log(x * n / (of * whole))).otherwise(0.0)

        seen, hit = F.col("n"), F.col("p")
        ratio = 2 * (
            part(hit, seen, positive) + part(seen - hit, seen, n - positive)
            + part(positive - hit, n - seen, positive) + part(n - seen - positive + hit, n - seen, n - positive)
        )
        least = 2 * float(np.log(max(found.count(), 1) + 1))
        best = found.where(hit * n > seen * positive).withColumn("ratio", ratio).where(F.col("ratio") >= least)
        got = best.orderBy(F.col("ratio").desc(), "term").limit(terms).collect()
        found.unpersist()
        return got

    chosen = strongest(counted(lambda text: {t for w in words_of(text) for t in terms_of(w)}))
    alone = {r["term"]: r["ratio"] for r in chosen[:crossed]}

    def pairs_of(text: str) -> set[str]:
        own: Counter = Counter()
        for w, k in words_of(text).items():
            own.update({t: k for t in terms_of(w) if t in alone})
        names = sorted(own)
        return {f"{a}&{b}" for k, b in enumerate(names) for a in names[: k + 1] if a != b or own[a] > 1}

    together = strongest(counted(pairs_of)) if len(alone) > 1 else []
    together = [r for r in together if r["ratio"] > 1.05 * max(alone[t] for t in r["term"].split("&"))]
    idf = {r["term"]: float(np.log((1 + n) / (1 + r["n"])) + 1) for r in [*chosen, *together[: terms // 4]]}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Vectors(idf)
        for pdf in batches:
            got = [make(t) for t in pdf["__text"]]
            yield pdf[["__id", "__label"]].assign(i=[i for i, _ in got], v=[v for _, v in got])

    kind = rows.schema["__id"].dataType.simpleString()
    got = rows.mapInPandas(vectors, f"__id {kind}, __label int, i array<bigint>, v array<double>").toPandas()  # at most `examples` rows
    rows.unpersist()
    got = got.sort_values("__id", kind="stable").reset_index(drop=True)
    pairs = [(np.array(i, np.int64), np.array(v)) for i, v in zip(got["i"], got["v"], strict=True)]
    return Model(idf, pairs, got["__label"].to_numpy(float), got["__id"].tolist(), k)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep=()) -> DataFrame:
    """Per row: id, the columns in `keep`, score, predicted, evidence (example:label:cosine, the nearest first)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # bounded by examples and terms
    own = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "__text")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            got = [m.score(t) for t in pdf["__text"]]
            s = np.array([p for p, _ in got], float)
            yield pdf.drop(columns="__text").assign(score=s, predicted=(s >= threshold).astype("int32"), evidence=[e for _, e in got])

    return own.mapInPandas(work, f"{kinds}, score double, predicted int, evidence string").withColumnRenamed("__id", id_col)
