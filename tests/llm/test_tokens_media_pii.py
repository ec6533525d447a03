"""Tokens against the tiktoken library, media round trips, personal data against the plain patterns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tarnwatch.llm import byte_bpe, pii, progressive_jpeg
from tarnwatch.llm.queries import tokenizer


@pytest.fixture(scope="module")
def library():
    import tiktoken

    path, pattern = tokenizer()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_round_trip(edge, empty, edge_rows, library):
    got = byte_bpe.round_trip(edge, *tokenizer(), keep=("source",)).collect()
    texts = sorted((t or "") for _, t, *_ in edge_rows)
    assert sorted(bytes(r["decoded"]).decode() for r in got) == texts
    for r in got:
        want = library.encode_ordinary(bytes(r["decoded"]).decode())
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want and r["n_tokens"] == len(want)
    assert byte_bpe.round_trip(empty, *tokenizer()).count() == 0


def test_pieces_of_any_letters(library):
    rng = random.Random(6)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(1, 60))) for a in ("ab", "aeth ", "éß日😀 \n", "0123 .,'s", "\x00\x7f​<|>") for _ in range(60)]
    texts += ["a" * 1000, "ab" * 500, "<|endoftext|>", "'s't're"]
    coder = byte_bpe.PieceCoder(*tokenizer(), cache_pieces=50)
    for t, (ids, back) in zip(texts, coder.batch(texts, chars=300), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t) and back == t.encode()


def test_media(edge, empty, edge_rows):
    for r in progressive_jpeg.media_column(edge.where("doc_id IS NULL OR doc_id <> 5"), tensors=True).collect():
        text = dict((i, t) for i, t, *_ in edge_rows)[r["doc_id"]] or ""
        raw = text.encode()
        assert r["n_bytes"] == len(raw) and bytes(r["payload"]) == raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert len(r["rgb"]) == r["width"] * r["height"] * 3
        assert np.array_equal(np.frombuffer(bytes(r["rgb"]), np.uint8).reshape(r["height"], r["width"], 3), progressive_jpeg.decode(bytes(r["media"])))
    assert progressive_jpeg.media_column(empty).count() == 0


@pytest.mark.parametrize("n", [1, 5, 70])
def test_both_ways_of_reading_agree(n, monkeypatch):
    payload = np.random.default_rng(n).integers(0, 256, 576 * n, dtype=np.uint8).tobytes()
    data = progressive_jpeg.store_payload(payload)
    fast, quant, size, comment = progressive_jpeg.coefficients(data)
    assert progressive_jpeg.payload_of(fast, size, comment) == payload
    if n < 20:
        monkeypatch.setattr(progressive_jpeg, "_even_scan", lambda *a: False)
        slow = progressive_jpeg.coefficients(data)[0]
        assert all(np.array_equal(a.coef, b.coef) for a, b in zip(fast, slow, strict=True))


def test_inverse_transform():
    d = progressive_jpeg.DCT
    assert np.allclose(d.T @ d, np.eye(8), atol=1e-5)
    assert progressive_jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_runs_and_zeros_bit_by_bit():
    """A grey picture whose AC scan has runs, an end-of-block run and a refinement that turns a zero on."""
    j = progressive_jpeg
    table = lambda kind, symbols: j._segment(0xC4, bytes([kind << 4, 0, 0, 0, len(symbols), *[0] * 12, *symbols]))
    bits = lambda s: np.array([int(c) for c in s], np.uint8)
    head = b"\xff\xd8" + j._segment(0xDB, b"\0" + b"\x01" * 64) + j._segment(0xC2, b"\x08\x00\x08\x00\x18\x01\x01\x11\x00")
    dc = table(0, [0, 3]) + j._scan([(1, 0)], 0, 0, 0, 0, bits("0001101" + "0000" + "0000"))  # 5, 5, 5
    # Two zeros, then +1; an end-of-block run over two blocks; two zeros, then -1.
    ac = table(1, [0x21, 0x10]) + j._scan([(1, 0)], 1, 63, 0, 1, bits("00001" + "00010" + "00000" + "00010"))
    first = j.coefficients(head + dc + ac + b"\xff\xd9")[0][0].coef.reshape(3, 64)
    want = np.zeros((3, 64), int)
    want[:, 0], want[0, 3], want[2, 3] = 5, 2, -2
    assert np.array_equal(first, want)
    # A new +1 at once and a correction; nothing; no correction.
    more = table(1, [0x01, 0x00]) + j._scan([(1, 0)], 1, 63, 1, 0, bits("00001" + "00011" + "0001" + "00010"))
    last = j.coefficients(head + dc + ac + more + b"\xff\xd9")
    want[0, 1], want[0, 3] = 1, 3
    assert np.array_equal(last[0][0].coef.reshape(3, 64), want)
    assert j.rgb_tensor(*last[:3]).shape == (8, 24, 3)


def plain(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_base_spans():
    rng = random.Random(9)
    texts = ["".join(rng.choice("01a9@.+- ()é%_") for _ in range(rng.randint(0, 80))) for _ in range(4000)]
    texts += ["x@a.b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4", "4111 1111-1111 1111", "+1 (988) 555-2485", "a" * 20000, "1" * 20000, "1." * 5000, "@" * 5000]
    for t in texts:
        assert pii.told(pii.base_spans(t)) == plain(t), t[:80]


def test_field_carries_labels_over(spark, make, edge, empty, edge_rows):
    rng = random.Random(2)
    rows = []
    for i in range(200):
        number = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        rows.append((i, f"call me at +1 {number} or write to me, invoice {rng.randint(10, 99)} due", "en", "a"))
    field = pii.fit(make(rows), examples=150)
    again = make([(1, "call +1 (988) 555-2485 now. Some words later: 555-2485 again, item 12", "en", "a")])
    r = pii.find(again, field).first()
    assert r["n_phone"] == 1 and r["base"] in r["spans"] and r["n_added"] >= 1
    assert pii.find(edge, field).count() == len(edge_rows)
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_tail_and_digest_of_queries(spark):
    from tarnwatch.llm.queries import op10_progressive_jpeg

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op10_progressive_jpeg(spark, sf).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_pii_label_reaches_all_repeats():
    texts = ["call +49301234567 now. " + "or dial 49301234567 again, as they said. " * 40]
    field = pii.Field(64)
    field.link[1] = 10.0 * np.eye(field.labels)
    field.trained = True
    kinds = [k for k, _, _ in field.added(texts, [pii.base_spans(texts[0])])[0]]
    assert kinds == [pii.KINDS.index("phone")] * 40


def test_long_pieces_and_digits(library):
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3000)), "7" * 20_000, " ".join(str(rng.randint(0, 10**6)) for _ in range(5000)), "=" * 9000]
    for t, (ids, back) in zip(texts, byte_bpe.PieceCoder(*tokenizer()).batch(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t) and back == t.encode()


def test_media_of_long_and_repeated_rows(make):
    long_text = "alpha beta gamma delta " * 9000
    rows = progressive_jpeg.media_column(make([(5, long_text, "de", "a"), (5, long_text, "de", "a"), (6, None, None, None)])).collect()
    raw = long_text.encode()
    assert [bytes(r["payload"]) for r in rows if r["doc_id"] == 5] == [raw + b"\xff" * (-len(raw) % 576)] * 2
    assert len({(bytes(r["media"]), r["feature"]) for r in rows if r["doc_id"] == 5}) == 1
    empty_row = next(r for r in rows if r["doc_id"] == 6)
    assert empty_row["n_bytes"] == 0 and bytes(empty_row["payload"]) == b"\xff" * 576


def test_spans_of_edge_rows(spark, make, edge_rows):
    field = pii.fit(make([(i, f"mail a{i}@b.example or call +49 30 1234{i:04d}", "en", "a") for i in range(50)]), examples=40)
    rows = edge_rows + [(90, "x@y.zz and 10.0.0.1, +49 30 1234567", "en", "a"), (90, "x@y.zz and 10.0.0.1, +49 30 1234567", "en", "a"), (91, " ".join(map(str, range(30_000))), "en", "a")]
    got = pii.find(make(rows), field).collect()
    want = {i: plain(t or "") for i, t, *_ in rows}
    assert len(got) == len(rows) and all(r["base"] == want[r["doc_id"]] for r in got)
    assert all((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 1) for r in got if r["doc_id"] == 90)
    assert len({r["spans"] for r in got if r["doc_id"] == 90}) == 1


def test_field_is_exact_on_a_tree():
    """Beliefs of a chain with one skip link and no cycle against sums over all labellings."""
    import itertools

    text = "call +49301234567; then x, 49301234567"
    field = pii.Field(64)
    rng = np.random.default_rng(3)
    field.node, field.link, field.trained = rng.normal(0, 0.5, field.node.shape), [rng.normal(0, 1, (5, 5)) for _ in range(2)], True
    g = pii.Graph([text], [[]], 64)  # nothing observed
    n = len(g.observed)
    theta = field.node[g.features].sum(axis=1)
    total = np.zeros((n, 5))
    for y in itertools.product(range(5), repeat=n):
        w = np.exp(sum(theta[k, y[k]] for k in range(n)) + sum(t[y[a], y[b]] for t, links in zip(field.link, g.links, strict=True) for a, b in links))
        for k in range(n):
            total[k, y[k]] += w
    assert sum(map(len, g.links)) == n - 1 > 0
    assert np.allclose(field.beliefs(g), total / total.sum(axis=1, keepdims=True), atol=1e-4)
