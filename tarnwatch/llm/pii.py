"""Personal data by rules and a skip-chain conditional random field.

Base spans follow from patterns (e-mail, IP, card with Luhn check, phone). The field's nodes are the tokens of a
document that hold a digit or an @. Its potentials: of each token by its shape and neighbouring words, of tokens
next to each other, and, across the whole document, of tokens that repeat or are alike (same letters and digits,
same last seven digits, same name before the @): each is linked to the next of its kind, so links grow with the
tokens, not with their square. Tokens in base spans are observed; loopy sum-product message passing carries their
labels to the others, and tokens that end up as personal data become further spans. Each round reaches one link
further; rounds go on until no message moves, and their bound grows with the tokens of the longest document.

The field is trained here: on a bounded sample of documents that have base spans (`examples`, those of the smallest
hashes of their ids), whose labels are the base spans, by gradient steps on the pseudo-likelihood, with features left
out at random so that the links get weight of their own.

Defined results: null text counts as empty and has no spans; texts are read whole, whatever their length, in time
linear in it and some hundred bytes for each token; base spans always stay; where spans of several kinds cover a token
the one that begins first is its label; without any base span in the sample nothing is added; repeated rows get the
same result; further columns are not touched and may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import one_row_each, ship, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does: what fails there fails at every later digit of the run.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s,;:\"'<>=|]*+")
_MARK = re.compile(r"[0-9@]")
_WORD = re.compile(r"\w+")

Span = tuple[int, int, int]  # kind, start, end
#: How many features() gives.
FEATURES = 12


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the name before it and the host after it, the next beginning where the last ended."""
    last = 0
    at = text.find("@")
    while at >= 0:
        host = _HOST.match(text, at)
        begin = at
        if host:
            while begin > last and text[begin - 1] in _NAME_CHARS:
                begin -= 1
            if begin < at:
                last = host.end()
                yield begin, last
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start. Matches that fail their check are dropped."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start():
            digits = re.sub("[ -]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens that hold a digit or an @."""
    at = 0
    for m in iter(lambda: _MARK.search(text, at), None):
        begin = m.start()
        while begin > at and _TOKEN.fullmatch(text, begin - 1, begin):
            begin -= 1
        at = max(_TOKEN.match(text, m.start()).end(), m.end())
        yield begin, at


def shape(token: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", token))


def features(text: str, begin: int, end: int, size: int) -> list[int]:
    """Hashed features of a token: shape, counts, and the words around it."""
    token = text[begin:end]
    digits = sum(c in "0123456789" for c in token)
    before, after = _WORD.findall(text[max(0, begin - 40) : begin]), _WORD.findall(text[end : end + 40])
    names = [
        f"s:{shape(token)}", f"r:{re.sub('9+', '9', shape(token))}", f"d:{min(digits, 20)}", f"l:{min(len(token), 40) // 4}",
        f"@:{token.count('@')}", f".:{min(token.count('.'), 5)}", f"-:{min(token.count('-'), 5)}", f"+:{token[:1]}",
        f"b:{before[-1].lower() if before else ''}", f"a:{after[0].lower() if after else ''}",
        f"n:{text[end : end + 3].strip()[:1].isdigit()}", "1",
    ]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % size for n in names]


def keys(token: str) -> list[str]:
    """What makes tokens alike."""
    plain = re.sub(r"[^0-9a-z@]", "", token.lower())
    digits = re.sub(r"[^0-9]", "", token)
    out = [f"t:{plain}"] if len(plain) >= 4 else []
    if len(digits) >= 7:
        out.append(f"d:{digits[-7:]}")
    if "@" in token and len(name := token.split("@")[0].lower()) >= 3:
        out.append(f"n:{name}")
    return out


class Graph:
    """Nodes and links of many documents at once, in arrays: some hundred bytes a token, however long a text is."""

    def __init__(self, texts: list[str], spans: list[list[Span]], size: int):
        from xxhash import xxh64_intdigest

        of, at, feats, observed, near, alike, skip = (array(c) for c in "iqHBiQi")
        pairs: list[np.ndarray] = []
        for d, text in enumerate(texts):
            last = None
            own = iter(sorted((a, b, k) for k, a, b in spans[d]))
            covering: list[tuple[int, int, int]] = []
            following = next(own, None)
            for a, b in tokens(text):
                n = len(of)
                while following and following[0] < b:
                    covering.append(following)
                    following = next(own, None)
                covering = [s for s in covering if s[1] > a]
                of.append(d)
                at.extend((a, b))
                feats.extend(features(text, a, b, size))
                observed.append(covering[0][2] + 1 if covering else 0)
                if last is not None and a - last[1] <= 3:
                    near.extend((last[0], n))
                for key in keys(text[a:b]):
                    alike.append(xxh64_intdigest(key.encode("utf-8", "surrogatepass")))
                    skip.append(n)
                last = (n, b)
            if len(skip):
                # Tokens alike stand in order once sorted; each is linked to the next of its kind.
                key, node = np.array(alike, np.uint64), np.array(skip, np.int32)
                order = np.lexsort((node, key))
                key, node = key[order], node[order]
                same = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1]))
                pairs.append(np.stack((node[same], node[same + 1]), axis=1))
                del alike[:], skip[:]
        self.of, self.at = np.array(of, np.int32), np.array(at, np.int64).reshape(-1, 2)
        self.features = np.array(feats, np.uint16).reshape(-1, FEATURES)
        self.observed = np.array(observed, np.int64)
        skips = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int32)
        self.links = [np.array(near, np.int32).reshape(-1, 2), skips]


def _normal(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class Field:
    """Node weights (features x 5 labels) and two tables of link weights (5 x 5): neighbours and skip links."""

    labels = 1 + len(KINDS)

    def __init__(self, size: int):
        self.size = size
        self.node = np.zeros((size, self.labels))
        self.prior = [np.zeros((self.labels, self.labels)), np.eye(self.labels)]
        self.link = [p.copy() for p in self.prior]
        self.trained = False

    def train(self, g: Graph, steps: int = 150, rate: float = 2.0, leave_out: float = 0.3, seed: int = 5) -> None:
        if not (g.observed > 0).any():
            return
        rng, n = np.random.default_rng(seed), len(g.observed)
        y = np.eye(self.labels)[g.observed]
        for _ in range(steps):
            use = (rng.random(g.features.shape) >= leave_out).astype(float)
            z = np.einsum("nf,nfl->nl", use, self.node[g.features])
            for table, links in zip(self.link, g.links, strict=True):
                np.add.at(z, links[:, 1], table[g.observed[links[:, 0]]])
                np.add.at(z, links[:, 0], table.T[g.observed[links[:, 1]]])
            off = y - np.exp(_normal(z))
            grad = np.zeros_like(self.node)
            np.add.at(grad, g.features, use[:, :, None] * off[:, None, :])
            self.node += rate * (grad / n - 1e-4 * self.node)
            for k, links in enumerate(g.links):
                t = np.zeros_like(self.link[k])
                np.add.at(t, g.observed[links[:, 0]], off[links[:, 1]])
                np.add.at(t.T, g.observed[links[:, 1]], off[links[:, 0]])
                self.link[k] += rate * (t / n - 1e-3 * (self.link[k] - self.prior[k]))
        self.trained = True

    def beliefs(self, g: Graph, least_rounds: int = 100, damping: float = 0.5, still: float = 1e-6, block: int = 1 << 15) -> np.ndarray:
        """Label probabilities of all nodes when messages have settled. Damped, a message takes some two rounds a
        link, so a document has least_rounds and four for each of its tokens; its messages stop once they are still."""
        theta = np.concatenate([np.zeros((0, self.labels)), *(self.node[g.features[k : k + block]].sum(axis=1) for k in range(0, len(g.features), block))])
        fixed = g.observed > 0
        theta[fixed] = np.where(np.eye(self.labels)[g.observed[fixed]] > 0, 0.0, -30.0)
        # Messages of one kind of link and one way stand together; `back` is how far off the one the other way is.
        ways, begin = [], 0
        for t, links in zip(self.link, g.links, strict=True):
            n = len(links)
            ways += [(begin, begin + n, t, n), (begin + n, begin + 2 * n, t.T, -n)]
            begin += 2 * n
        src = np.concatenate([x for links in g.links for x in (links[:, 0], links[:, 1])])
        dst = np.concatenate([x for links in g.links for x in (links[:, 1], links[:, 0])])
        msg = np.zeros((len(src), self.labels))
        bound = least_rounds + 4 * np.bincount(g.of)
        live, done = np.arange(len(src), dtype=np.int32), 0
        while len(live):
            # Documents are apart from each other: only messages of those not yet settled are sent again.
            into, new, most = theta.copy(), np.empty((len(live), self.labels)), np.zeros(len(bound))
            for k in range(0, len(live), block):
                e = live[k : k + block]
                np.add.at(into, dst[e], msg[e])
            for first, end, pot, back in ways:
                lo, hi = np.searchsorted(live, (first, end))
                for k in range(lo, hi, block):
                    e = live[k : min(k + block, hi)]
                    z = (into[src[e]] - msg[e + back])[:, :, None] + pot
                    top = z.max(axis=1, keepdims=True)
                    got = _normal((top + np.log(np.exp(z - top).sum(axis=1, keepdims=True)))[:, 0, :])
                    np.maximum.at(most, g.of[src[e]], np.abs(got - msg[e]).max(axis=1))
                    new[k : k + len(e)] = got
            for k in range(0, len(live), block):
                e = live[k : k + block]
                msg[e] = damping * msg[e] + (1 - damping) * new[k : k + block]
            done += 1
            live = live[((most > still) & (done < bound))[g.of[src[live]]]]
        np.add.at(theta, dst, msg)
        return np.exp(_normal(theta))

    def added(self, texts: list[str], spans: list[list[Span]], least: float = 0.5) -> list[list[Span]]:
        """Further spans of each text: tokens outside base spans that are personal data; neighbours of one kind,
        one space apart, are one span."""
        out: list[list[Span]] = [[] for _ in texts]
        if not self.trained:
            return out
        g = Graph(texts, spans, self.size)
        if not len(g.observed):
            return out
        p = self.beliefs(g)
        best = p[:, 1:].argmax(axis=1)
        for n in np.flatnonzero((g.observed == 0) & (p[:, 1:].max(axis=1) >= least)).tolist():
            d, (a, b), kind = int(g.of[n]), g.at[n].tolist(), int(best[n])
            while b > a and texts[d][b - 1] in ".!?)]":
                b -= 1
            if b <= a:
                continue
            own = out[d]
            if own and own[-1][0] == kind and a - own[-1][2] == 1 and texts[d][a - 1] == " ":
                own[-1] = (kind, own[-1][1], b)
            else:
                own.append((kind, a, b))
        return out


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = 2000, size: int = 4096) -> Field:
    ship(docs.sparkSession)
    likely = F.col(text_col).contains("@") | F.col(text_col).rlike(r"[0-9][0-9.() -]{6}")
    marked = docs.where(likely).select(F.col(id_col).alias("__id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("__h"))
    few = marked.orderBy("__h", "__id").limit(examples).distinct()
    texts = docs.where(likely).select(F.col(id_col).alias("__id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("__h"), F.col(text_col).alias("__text"))
    sample = texts.join(F.broadcast(few.select("__h")), "__h", "left_semi")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Only what lies around tokens is needed: it goes to the driver, whole texts don't. Slices that meet are one."""
        for pdf in batches:
            out = []
            for t in pdf["__text"]:
                spans, kept = base_spans(t), []
                if spans:
                    for a, b in tokens(t):
                        a, b = max(0, a - 48), b + 48
                        if kept and a <= kept[-1][1]:
                            kept[-1][1] = b
                        else:
                            kept.append([a, b])
                out.append("\n".join(t[a:b] for a, b in kept))
            yield pdf[["__h"]].assign(around=out)

    cuts = one_row_each(sample.mapInPandas(cut, "__h bigint, around string"), ["__h"], ["around"])
    got = cuts.toPandas().sort_values("__h", kind="stable")  # at most `examples` rows
    texts_ = [t for t in got["around"].tolist() if t]
    field = Field(size)
    if texts_:
        field.train(Graph(texts_, [base_spans(t) for t in texts_], size))
    return field


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone (base spans), base, spans (base and added), n_added."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(field)
    own = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    kind = own.schema["__id"].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = sent.value
        for pdf in batches:
            texts = pdf["__text"].tolist()
            base = [base_spans(t) for t in texts]
            more: list[list[Span]] = []
            for at in range(0, len(texts), 1000):
                more += f.added(texts[at : at + 1000], base[at : at + 1000])
            count = {f"n_{name}": [sum(s[0] == k for s in b) for b in base] for k, name in enumerate(KINDS)}
            yield pdf[["__id"]].assign(
                **count, base=[told(b) for b in base], spans=[told(b + m) for b, m in zip(base, more, strict=True)], n_added=[len(m) for m in more]
            )

    counts = "".join(f"n_{k} bigint, " for k in KINDS)
    return own.mapInPandas(work, f"__id {kind}, {counts}base string, spans string, n_added bigint").withColumnRenamed("__id", id_col)

