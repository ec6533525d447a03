"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's subwords are its byte n-grams (`sizes`), lower-cased, letters and single spaces only, so that they know
where words begin and end; each is hashed to one of `buckets` embeddings. Their average goes through a linear
softmax. Embeddings and softmax are trained together by stochastic gradient descent in numpy on a bounded sample
of labelled texts (`examples`, those of the smallest hashes of their ids, evenly over languages as far as there are,
two of each language at least) of the `languages` that most rows have, ties by code point.
A part of the sample is held back to calibrate: a temperature makes scores probabilities, and texts whose score
falls below the `reject` quantile of that part are marked as rejected.

Scoring needs one number per bucket and language, the embedding times the softmax, so a text is a sum of rows.

Defined results: null texts and texts without a letter are `und` with score 0, rejected; short texts get a
prediction from what they have; without labelled rows every text is `und`; with a single language in the sample that
language is predicted for all; ties go to the language first in code point order; repeated rows score alike, and
of rows that share an id only the one of the smallest language, then text, is learned, among those whose language and
text are not null; very long texts are read whole, in blocks; further columns are not touched and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.llm.common import one_row_each, ship, written

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def subwords(text: str, buckets: int, sizes=(2, 3, 4)) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords, in blocks of long texts; none if the text has no letter."""
    norm = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, norm)):
        return
    raw = np.frombuffer(f" {norm} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    for begin in range(0, len(raw), 1 << 18):
        b = raw[begin : begin + (1 << 18) + max(sizes) - 1]
        h = np.zeros(len(b), np.uint32)
        for k in range(max(sizes)):
            h = h[: len(b) - k] * np.uint32(0x01000193) + b[k:]
            if k + 1 in sizes:
                x = (h ^ np.uint32((k + 1) * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                # Block borders: n-grams that begin in the overlap belong to the next block.
                yield ((x ^ (x >> np.uint32(15))) & np.uint32(buckets - 1))[: 1 << 18]


def counts_of(text: str, buckets: int) -> np.ndarray | None:
    """Subword counts by bucket, as shares of all; None if there are none."""
    total = np.zeros(buckets, np.float32)
    for ids in subwords(text, buckets):
        total += np.bincount(ids, minlength=buckets)
    n = total.sum()
    return total / n if n else None


class LanguageModel:
    def __init__(self, names: list[str], rows: np.ndarray, bias: np.ndarray, temperature: float, floor: float):
        self.names, self.rows, self.bias = names, rows, bias
        self.temperature, self.floor = temperature, floor

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.names)), 0
        for ids in subwords(text, len(self.rows)):
            total += np.bincount(ids, minlength=len(self.rows)) @ self.rows
            n += len(ids)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        z = self.logits(text) if text is not None and self.names else None
        if z is None:
            return "und", 0.0, True
        p = softmax(z[None, :] / self.temperature)[0]
        best = int(np.argmax(p))
        return self.names[best], float(p[best]), bool(p[best] < self.floor)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, width: int, epochs: int, rate: float, seed: int = 8):
    """SGD over embeddings (buckets x width) and softmax (width x classes); y: class numbers."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (x.shape[1], width)).astype(np.float32)
    out = rng.normal(0, 0.1, (width, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    # Averages of many subwords are alike; their spread sets the step.
    scale = 1.0 / max(float(np.sqrt((x * x).sum(axis=1)).mean()), 1e-6)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 16)):
            a = x[at] * scale
            hidden = a @ emb
            p = softmax(hidden @ out + bias)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            back = p @ out.T
            out -= step * (hidden.T @ p)
            bias -= step * p.sum(axis=0)
            emb -= step * (a.T @ back)
    return (emb @ out * scale).astype(np.float64), bias.astype(np.float64)


def fit(
    docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    examples: int = 2400, languages: int = 2000, buckets: int = 4096, width: int = 16, epochs: int = 30, rate: float = 0.5, reject: float = 0.005,
) -> LanguageModel:
    ship(docs.sparkSession)
    marked = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & learn)
    # Only ids and languages take part in the choice; the texts of those chosen follow.
    thin = marked.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.xxhash64(F.col(id_col)).alias("__h"))
    langs = written(thin.groupBy("__lang").agg(F.count("*").alias("__of")).orderBy(F.desc("__of"), "__lang").limit(languages), "languages")
    known = langs.count()
    if not known:
        return LanguageModel([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 1.0)
    each = max(2, examples // known)
    # A share of each language a little above what is needed, cut to the number: no window over all rows.
    drawn = thin.join(F.broadcast(langs), "__lang")  # `languages` rows at most
    drawn = drawn.where(F.pmod("__h", F.lit(1 << 30)) < F.least(F.lit(1.0), (1.5 * each + 30) / F.col("__of")) * (1 << 30))
    first = Window.partitionBy("__lang").orderBy("__h", "__id")
    few = drawn.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= each).select("__id", "__lang").distinct()
    texts = marked.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    sample = texts.join(F.broadcast(few), ["__id", "__lang"])  # `examples`, or two for each of `languages`
    sample = one_row_each(sample, ["__id"], ["__lang", "__text"])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [counts_of(t, buckets) for t in pdf["__text"]]
            ok = [g is not None for g in got]
            yield pdf.loc[ok, ["__id", "__lang"]].assign(x=[g.astype("<f4").tobytes() for g in got if g is not None])

    kind = sample.schema["__id"].dataType.simpleString()
    got = sample.mapInPandas(features, f"__id {kind}, __lang string, x binary").toPandas()  # examples * buckets floats
    got = got.sort_values("__id", kind="stable")
    if not len(got):
        return LanguageModel([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 1.0)
    names = sorted(got["__lang"].unique())
    x = np.frombuffer(b"".join(got["x"]), "<f4").reshape(len(got), buckets)
    y = np.searchsorted(names, got["__lang"].to_numpy(object).astype(str))
    back = np.arange(len(x)) % 5 == 4
    if back.sum() < 10:
        back[:] = False
    rows, bias = train(x[~back], y[~back], len(names), width, epochs, rate)
    if not back.any() or len(names) < 2:
        return LanguageModel(names, rows, bias, 1.0, 0.0)
    z = x[back] @ rows + bias
    loss = [(-np.log(softmax(z / t)[np.arange(len(z)), y[back]] + 1e-12).mean(), t) for t in np.geomspace(0.1, 10, 60)]
    temperature = min(loss)[1]
    best = softmax(z / temperature).max(axis=1)
    return LanguageModel(names, rows, bias, float(temperature), float(np.quantile(best, reject)))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score, rejected."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # buckets * languages numbers
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = own.schema["__id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            got = [m.predict(t if isinstance(t, str) else None) for t in pdf["__text"]]
            yield pdf[["__id"]].assign(lang_pred=[a for a, _, _ in got], score=[b for _, b, _ in got], rejected=[c for *_, c in got])

    return own.mapInPandas(work, f"__id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("__id", id_col)
