"""Byte-level BPE by DuckDB recursive queries inside each partition.

A piece (one match of the split pattern) is a row whose state holds its tokens, one private-use character
each. A step of the recursive query lays the state out as token-position rows, joins neighbouring tokens with
the merge table, takes each piece's leftmost pair of minimum rank, and contracts it; a piece without a pair
left drops out, and the query ends when none is active: the fixpoint. Where no earlier merge can come of it,
all occurrences of the pair are contracted in that step, which gives the same tokens in fewer steps.
The state is keyed by piece, so memory holds one state per piece, not one per step.

Decoding joins (piece, position, token) rows with the vocabulary and aggregates their bytes in order.

Pieces repeat, so each Python worker keeps those it has seen of late, up to about `cache_pieces` of them, and
texts are put together from pieces. Tasks hold one Arrow batch of texts at a time, and yield it in parts of about `part_bytes`.

Defined results: null text counts as empty; an empty text has no ids and decodes to empty; texts of any length
are read whole; rows that repeat get the same ids each; an empty table gives an empty result; other columns of the input
are not touched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.llm.common import ship, text_or_empty

_FIRST = 0xF0000  # the first private-use character: token 0
_POS = 1 << 40  # rank and position share 64 bits

#: Of each pair the merge table has `key`: its rank, and whether it may be made everywhere at once.
ENCODE = f"""
WITH RECURSIVE t(piece, state) USING KEY (piece) AS (
  SELECT piece, state FROM pieces
  UNION
  SELECT piece, CASE WHEN safe = 1 THEN replace(state, substr(state, spot, 2), merged)
    ELSE left(state, spot - 1) || merged || substr(state, spot + 2) END
  FROM (
    SELECT t.piece, t.state, (best.k % {_POS})::INT AS spot, (best.k // {_POS}) % 2 AS safe,
      chr(({_FIRST} + best.k // {2 * _POS})::INT) AS merged
    FROM t JOIN (
      SELECT p.piece, min(m.key * {_POS} + p.position) AS k
      FROM (SELECT piece, unnest(tokens) || unnest(tokens[2:]) AS pair, generate_subscripts(tokens, 1) AS position
            FROM (SELECT piece, string_split(state, '') AS tokens FROM t WHERE length(state) > 1)) p
      JOIN merges m ON p.pair = m.pair
      GROUP BY p.piece) best ON t.piece = best.piece)
)
SELECT piece, state FROM t
"""

DECODE = """
SELECT s.piece, string_agg(v.hex, '' ORDER BY s.position) AS hex
FROM (SELECT piece, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS position
      FROM (SELECT piece, string_split(state, '') AS tokens FROM states)) s
JOIN vocabulary v ON s.token = v.token GROUP BY s.piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PieceCoder:
    """Encodes and decodes pieces by DuckDB; one per task."""

    def __init__(self, ranks_path: str, pattern: str, cache_pieces: int = 300_000, at_once: int = 60_000):
        import duckdb
        import pyarrow as pa
        import regex

        ranks = read_ranks(ranks_path)
        splits = [
            (ranks[t[:i]], ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        ways: dict[int, list[tuple[int, int]]] = {}
        for a, b, r in splits:
            ways.setdefault(r, []).append((a, b))
        # A token is safe to make everywhere at once if nothing it takes part in ranks before it, and no two
        # of its ways to be made can overlap.
        early = {x for a, b, r in splits for x in (a, b) if r <= x}
        overlap = {r for r, w in ways.items() if len(w) > 1 and {a for a, _ in w} & {b for _, b in w}}
        unsafe = early | overlap
        char = lambda i: chr(_FIRST + i)
        self.byte = [char(ranks[bytes([i])]) for i in range(256)]
        self.whole = {t: char(r) for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        #: Pieces seen of late, and those before them: piece -> (ids, decoded bytes).
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.limit, self.at_once = cache_pieces, at_once
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '300MB'; SET temp_directory = ''")
        self._put(
            "merges",
            pa.table({
                "pair": [char(a) + char(b) for a, b, _ in splits],
                "key": pa.array([2 * r + (r not in unsafe) for *_, r in splits], pa.int64()),
            }),
        )
        self._put("vocabulary", pa.table({"token": [char(r) for r in ranks.values()], "hex": [t.hex() for t in ranks]}))

    def _put(self, name: str, rows) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def learn(self, pieces: list[str]) -> None:
        """Adds pieces that are not known yet."""
        import numpy as np
        import pyarrow as pa

        for i in range(0, len(pieces), self.at_once):
            some = pieces[i : i + self.at_once]
            raw = [p.encode() for p in some]
            # A piece that is a token as a whole is that token.
            start = [self.whole.get(b) or "".join([self.byte[c] for c in b]) for b in raw]
            self._put("pieces", pa.table({"piece": pa.array(range(len(some)), pa.int32()), "state": start}))
            self.db.execute(f"CREATE OR REPLACE TABLE states AS {ENCODE}")
            at, states = self._columns("SELECT piece, state FROM states ORDER BY piece")
            ids = (np.frombuffer("".join(states).encode("utf-32-le"), "<u4") - np.uint32(_FIRST)).tobytes()
            ends = np.cumsum([len(x) for x in states]) * 4
            _, back = self._columns(DECODE + " ORDER BY s.piece")
            begin = 0
            for p, end, hexed in zip(some, ends.tolist(), back, strict=True):
                self.known[p] = (ids[begin:end], bytes.fromhex(hexed))
                begin = end

    def _columns(self, sql: str) -> list[list]:
        return [c.to_pylist() for c in self.db.sql(sql).to_arrow_table().columns]

    def _need(self, pieces: set[str]) -> None:
        """Makes all of them known; pieces that come again move on to the newer half."""
        if len(self.known) > self.limit // 2:
            self.older, self.known = self.known, {}
        new = []
        for p in pieces - self.known.keys():
            if (had := self.older.get(p)) is not None:
                self.known[p] = had
            else:
                new.append(p)
        self.learn(new)

    def batch(self, texts: list[str], chars: int = 6_000_000) -> Iterator[tuple[bytes, bytes]]:
        """Per text its ids, as little-endian unsigned 32-bit integers, and the bytes they decode to."""
        held: list[list[str]] = []
        size = 0
        for n, text in enumerate(texts, 1):
            held.append(self.find(text))
            size += len(text)
            if size >= chars or n == len(texts):
                self._need(set().union(*held))
                for pieces in held:
                    got = [self.known[p] for p in pieces]
                    yield b"".join([x for x, _ in got]), b"".join([x for _, x in got])
                held, size = [], 0


#: One coder per Python worker, so that tasks share what earlier ones have learned.
_CODERS: dict[tuple[str, str], PieceCoder] = {}


def coder(ranks_path: str, pattern: str) -> PieceCoder:
    key = (ranks_path, pattern)
    if key not in _CODERS:
        _CODERS[key] = PieceCoder(ranks_path, pattern)
    return _CODERS[key]


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
    part_bytes: int = 8_000_000,
) -> DataFrame:
    """Per row: id, the columns in `keep`, n_tokens, ids (binary, little-endian u32) and decoded (binary)."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"), *[F.col(c) for c in keep])
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = f"__id {kinds['__id']}, " + "".join(f"`{c}` {kinds[c]}, " for c in keep) + "n_tokens bigint, ids binary, decoded binary"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tarnwatch.llm.byte_bpe import coder

        own_coder = coder(ranks_path, pattern)
        for pdf in batches:
            rest, out, size = pdf.drop(columns="__text"), [], 0
            begun = 0
            for n, (ids, back) in enumerate(own_coder.batch(pdf["__text"].tolist()), 1):
                out.append((len(ids) // 4, ids, back))
                size += len(ids) + len(back)
                if size > part_bytes or n == len(pdf):
                    part = rest.iloc[begun:n].reset_index(drop=True)
                    yield part.join(pd.DataFrame(out, columns=["n_tokens", "ids", "decoded"]))
                    out, size, begun = [], 0, n

    return own.mapInPandas(work, schema).withColumnRenamed("__id", id_col)
