"""Quality by co-training: a classifier of the text content and one of the page's metadata teach each other.

The content view is all that is read off the text: hashed words and word pairs, how often they repeat, its lines, and
its shares of letters, digits, marks, capitals and spaces; the metadata view is what is recorded of a page beside its
text: its source, its language, and the two together. Its length is in neither by name, and counts with the content,
whose shares give it away. So neither view's features can be rebuilt from the other's. Both are logistic models trained in numpy on a bounded sample: `labelled` rows with labels and
`unlabelled` rows without (those of the smallest hashes of their ids). In each round either view labels the
unlabelled rows it is surest of, as many of each class as the base rate asks for, and the other view learns them.
A part of the labelled rows is held back: on it each view is calibrated (Platt), and so is the sum of the two
calibrated log-odds, which scores all documents.

Defined results: null text counts as empty and null metadata as a value of its own; empty texts get a score like
any other; without labelled rows, or with labels of one class only, every score is the base rate (1 without rows:
documents are kept); labels that contradict each other count as the lower; repeated rows score alike, and of rows that
share an id only the one of the smallest text is learned; ties of what a view is surest of go by the rows' ids; very
long texts are read whole; further columns are not touched and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import one_row_each, ship, text_or_empty

_WORD = re.compile(r"\S+")


def character_shares(text: str) -> list[float]:
    """Shares of letters, digits, marks, capitals, spaces and line ends (Latin capitals; all else beyond is letters)."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    low = a | 32
    letter = ((low >= 97) & (low <= 122)) | (a >= 0xC0)
    digit = (a >= 48) & (a <= 57)
    space = (a == 32) | ((a >= 9) & (a <= 13)) | (a == 0xA0)
    capital = ((a >= 65) & (a <= 90)) | ((a >= 0xC0) & (a <= 0xDE) & (a != 0xD7))
    n = max(len(a), 1)
    return [float(np.count_nonzero(x)) / n for x in (letter, digit, ~(letter | digit | space), capital, space, a == 10)]


#: Features of the content view beside the hashed ones.
SHAPE = 18


def content_features(text: str, buckets: int) -> np.ndarray:
    """Shares of hashed words and pairs, square-rooted, measures of repetition, lines and kinds of characters."""
    words = _WORD.findall(text.lower())
    x = np.zeros(buckets + SHAPE, np.float32)
    share, lines = character_shares(text), text.count("\n") + 1
    x[buckets + 4 :] = [np.log1p(lines) / 5, np.log1p(max(len(text), 1) / lines) / 10, *share, *[float(s > 0.2) for s in share]]
    if not words:
        x[buckets + 3] = 1
        return x
    ids = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    pairs = (ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:]) >> np.uint64(20)
    both = np.concatenate((ids, pairs)) % np.uint64(buckets)
    x[:buckets] = np.sqrt(np.bincount(both.astype(np.int64), minlength=buckets) / len(both))
    _, n = np.unique(ids, return_counts=True)
    x[buckets] = 1 - len(n) / len(ids)
    x[buckets + 1] = n.max() / len(ids)
    x[buckets + 2] = (ids[1:] == ids[:-1]).mean() if len(ids) > 1 else 0
    return x


def metadata_features(source: str | None, lang: str | None, buckets: int = 64) -> np.ndarray:
    named = np.zeros(buckets, np.float32)
    for name in (f"source:{source}", f"lang:{lang}", f"both:{source}:{lang}"):
        named[zlib.crc32(name.encode("utf-8", "surrogatepass")) % buckets] = 1
    return named


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Logistic:
    """Logistic regression on standardised features, by gradient steps with momentum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200, rate: float = 0.5, pull: float = 1e-3):
        self.mean = x.mean(axis=0)
        self.scale = 1 / (x.std(axis=0) + 1e-3)
        z = (x - self.mean) * self.scale / np.sqrt(x.shape[1])
        self.w, self.b = np.zeros(x.shape[1], np.float32), 0.0
        speed, total = np.zeros_like(self.w), weight.sum()
        for _ in range(steps):
            off = (_sigmoid(z @ self.w + self.b) - y) * weight / total
            speed = 0.9 * speed - rate * (z.T @ off + pull * self.w)
            self.w += speed * 4
            self.b -= rate * off.sum() * 4
        self.w = (self.w * self.scale / np.sqrt(x.shape[1])).astype(np.float32)
        self.b = float(self.b - self.mean @ self.w)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * z + b) is calibrated; a is not negative."""
    a, b = 1.0, 0.0
    goal = (y * y.sum() + y) / (y.sum() + 2) + (1 - y) / ((1 - y).sum() + 2)
    for _ in range(500):
        off = _sigmoid(a * z + b) - goal
        a, b = max(0.0, a - 0.3 * float((off * z).mean()) / (1 + float((z * z).mean()))), b - 0.3 * float(off.mean())
    return a, b


class Model:
    def __init__(self, base: float, buckets: int):
        self.base, self.buckets, self.views, self.scales, self.last = base, buckets, None, None, (1.0, 0.0)

    def scores(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.full(len(content), self.base)
        z = [a * v.raw(x) + b for v, x, (a, b) in zip(self.views, (content, meta), self.scales, strict=True)]
        return _sigmoid(self.last[0] * (z[0] + z[1]) + self.last[1])


def co_train(content, meta, y, free_content, free_meta, buckets: int, rounds: int, sure: int) -> Model:
    """y: 0 or 1 for each labelled row; the free rows have none."""
    model = Model(float(y.mean()), buckets)
    back = np.arange(len(y)) % 4 == 3
    if back.sum() < 8 or len(set(y[back])) < 2:
        back[:] = False
    views, free = (content, meta), (free_content, free_meta)
    lent = [np.full(len(free_content), -1.0), np.full(len(free_content), -1.0)]  # what either view has been taught
    own = [None, None]
    for turn in range(rounds + 1):
        for k in (0, 1):
            taught = lent[k] >= 0
            x = np.concatenate((views[k][~back], free[k][taught]))
            goal = np.concatenate((y[~back], lent[k][taught]))
            weight = np.concatenate((np.ones((~back).sum()), np.full(taught.sum(), 0.5)))
            own[k] = Logistic(x, goal, weight)
        if turn == rounds or not len(free_content):
            break
        for k in (0, 1):
            z = own[k].raw(free[k])
            order = np.argsort(z, kind="stable")
            low = order[: max(1, int(sure * (1 - model.base)))]
            high = order[-max(1, int(sure * model.base)) :]
            lent[1 - k][low[z[low] < -1]] = 0.0
            lent[1 - k][high[z[high] > 1]] = 1.0
    on = back if back.any() else ~back
    model.views = own
    model.scales = [platt(own[k].raw(views[k][on]), y[on]) for k in (0, 1)]
    z = sum(a * own[k].raw(views[k][on]) + b for k, (a, b) in enumerate(model.scales))
    model.last = platt(z, y[on])
    return model


def fit(
    docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    lang_col: str = "lang", label_col: str = "quality", labelled: int = 3000, unlabelled: int = 3000, buckets: int = 1024,
    rounds: int = 4, sure: int = 300,
) -> Model:
    ship(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn)
    marked = marked.groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("double").alias("__label"))
    ids = docs.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()
    known = marked.join(ids, "__id", "left_semi").orderBy(F.xxhash64("__id"), "__id").limit(labelled)
    named = labels.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()
    free = ids.join(named, "__id", "left_anti").orderBy(F.xxhash64("__id"), "__id").limit(unlabelled)
    few = known.unionByName(free.withColumn("__label", F.lit(-1.0)))
    own = docs.select(
        F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"), F.col(source_col).alias("__source"), F.col(lang_col).alias("__lang")
    )
    sample = one_row_each(own.join(F.broadcast(few), "__id"), ["__id"], ["__label", "__text", "__source", "__lang"])
    kind = sample.schema["__id"].dataType.simpleString()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = [content_features(t, buckets).astype("<f4").tobytes() for t in pdf["__text"]]
            m = [metadata_features(*r).astype("<f4").tobytes() for r in _plain(pdf)]
            yield pdf[["__id", "__label"]].assign(c=c, m=m)

    got = sample.mapInPandas(features, f"__id {kind}, __label double, c binary, m binary").toPandas()  # at most labelled + unlabelled rows
    got = got.sort_values("__id", kind="stable")
    y = got["__label"].to_numpy(float)
    if not (y >= 0).any() or len(set(y[y >= 0])) < 2:
        return Model(float(y[y >= 0].mean()) if (y >= 0).any() else 1.0, buckets)
    c, m = (np.frombuffer(b"".join(got[k]), "<f4").reshape(len(got), -1) for k in ("c", "m"))
    return co_train(c[y >= 0], m[y >= 0], y[y >= 0], c[y < 0], m[y < 0], buckets, rounds, sure)


def _plain(pdf: pd.DataFrame) -> Iterator[tuple]:
    """(source, lang) with None for nulls of any kind."""
    for s, g in zip(pdf["__source"], pdf["__lang"], strict=True):
        yield s if isinstance(s, str) else None, g if isinstance(g, str) else None


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    threshold: float = 0.5,
) -> DataFrame:
    """Per row: id, score (1: good), predicted."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    own = docs.select(
        F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"), F.col(source_col).alias("__source"), F.col(lang_col).alias("__lang")
    )
    kind = own.schema["__id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            rows, texts = list(_plain(pdf)), pdf["__text"].tolist()
            got = [np.zeros(0)]
            for at in range(0, len(rows), 512):
                content = np.array([content_features(t, m.buckets) for t in texts[at : at + 512]])
                got.append(m.scores(content, np.array([metadata_features(*r) for r in rows[at : at + 512]])))
            s = np.concatenate(got)
            yield pdf[["__id"]].assign(score=s, predicted=(s >= threshold).astype("int32"))

    return own.mapInPandas(work, f"__id {kind}, score double, predicted int").withColumnRenamed("__id", id_col)
