"""The prefix trie, centroid clustering and packing, against plain-Python versions."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tarnwatch.llm import centroids, packing, prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, key string, n_convs double"


@pytest.fixture(scope="module")
def talk(spark):
    """Conversations with further columns whose names clash with the operator's."""
    return lambda rows: spark.createDataFrame([(*r, "d", "k", 0.5) for r in rows], CONVERSATIONS)


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            token = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0), token, len(text or "")))
    own = {c: [(t, n) for _, t, n in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * (p[-1][1] if p else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(w), len(p), min(members[p[:-1]]) if p else -(10**9), len(w), children[p], leaves[p], saved[p], digest(ends[p])) for p, w in members.items())


def made_trie(df):
    return sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def random_talk(n, seed):
    """Few first turns, some very common conversations, some long, ids of several blocks and signs."""
    rng = random.Random(seed)
    common = [("user", f"t{k} é😀"[: 2 + k % 4]) for k in range(9)]
    rows = []
    for c in rng.sample(range(-250, 900), n):
        kind = rng.random()
        turns = common[: rng.randint(1, 9)] if kind < 0.4 else [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "cc"])) for _ in range(rng.choice([1, 2, 3, 5, 8, 40]))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "seed", "tasks"), [(300, 1, 8), (300, 2, 31), (40, 3, 200), (2, 4, 8)])
def test_trie(spark, talk, n, seed, tasks):
    rows = random_talk(n, seed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        assert made_trie(prefix_trie.prefix_trie(talk(rows))) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_edges(talk):
    rows = [
        (None, 0, "user", "of no conversation"), (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "user", "w"), (2, 5, "user", ""),
        (7, 1, "a", "bc"), (8, 1, "ab", "c"), (13, 0, "user", "long " * 50_000), (-5, 0, "user", "x"), (105, 0, "user", "base 100 is absent"),
    ]
    assert made_trie(prefix_trie.prefix_trie(talk(rows))) == plain_trie(rows)
    assert prefix_trie.prefix_trie(talk([])).count() == 0
    turnless = next(c for c in range(1000, 1100) if c % 100 and zlib.crc32(str(c).encode()) % 6 == 5)
    assert made_trie(prefix_trie.prefix_trie(talk([(turnless, 0, "user", "x")]))) == [(turnless, 0, -(10**9), 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_loser_tree_compares_no_shared_turn_again(monkeypatch):
    """Entries come out in order with the turns they share, and no more turns are compared than there are new ones."""
    rng = random.Random(5)
    token = lambda k: bytes([k]) * prefix_trie.WIDTH
    runs, compared = [], 0
    for _ in range(7):
        seqs = sorted(b"".join(token(rng.randint(0, 1)) for _ in range(rng.randint(0, 12))) for _ in range(50))
        runs.append([(s, prefix_trie.shared(seqs[i - 1], s) if i else 0) for i, s in enumerate(seqs)])
    plain = prefix_trie.shared

    def counted(a, b, known=0):
        nonlocal compared
        both = plain(a, b, known)
        compared += both - known
        return both

    monkeypatch.setattr(prefix_trie, "shared", counted)
    out = [(common, e[0]) for common, e in prefix_trie.LoserTree(runs)]
    assert [s for _, s in out] == sorted(s for r in runs for s, _ in r)
    assert all(common == plain(a, b) for (_, a), (common, b) in zip(out, out[1:]))
    assert compared <= sum(len(s) // prefix_trie.WIDTH for r in runs for s, _ in r)


VECTORS = "vec_id long, embedding array<float>, cluster string, distance string"


def plain_clusters(rows, k=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**21 for x in v):
            kept.append((i, [int(np.floor(float(np.float32(x)) * 64)) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    cents = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for n, vs in groups.items():
            cents[n] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    own = Counter()
    for _, c, d in found:
        own[c] += d
    return sorted((repr(i), c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for i, c, d in found)


def made_clusters(df):
    return sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters(spark, seed):
    """Blobs of vectors, many of them equal or equally far from two centroids."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, 64))
    rows = [(i, (middle[rng.integers(9)] + rng.normal(size=64) * 0.05).tolist()) for i in range(400)]
    rows += [(1000 + i, [float(i % 3)] * 64) for i in range(200)]
    got = centroids.clusters(spark.createDataFrame([(*r, "c", "d") for r in rows], VECTORS).repartition(7))
    assert made_clusters(got) == plain_clusters(rows)


def test_cluster_edges(spark):
    flat = lambda x: [x] * 64
    rows = [
        (None, flat(0.5)), (1, flat(0.5)), (1, flat(0.5)), (1, flat(-0.01)), (2, None), (3, []), (4, flat(1.0)[:63]), (5, [None, *flat(1.0)[1:]]),
        (6, [float("nan"), *flat(1.0)[1:]]), (7, [float("inf"), *flat(1.0)[1:]]), (8, flat(2.0**20)), (9, flat(2.0**21)), (10, flat(-(2.0**20))),
    ]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], VECTORS)
    assert made_clusters(centroids.clusters(df)) == plain_clusters(rows)
    assert len(made_clusters(centroids.clusters(df))) == 6
    assert centroids.clusters(df.limit(0)).count() == 0
    assert made_clusters(centroids.clusters(df.where("vec_id = 8"))) == plain_clusters([(8, flat(2.0**20))])


def test_bounds_certify_most(spark):
    """After the first round only some vectors are compared with all centroids, and the state has fewer bounds than centroids."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(16, 64)) * 3
    rows = [(i, (middle[i % 16] + rng.normal(size=64) * 0.1).tolist(), "c", "d") for i in range(1600)]
    state, _ = centroids.cluster(spark.createDataFrame(rows, VECTORS))
    work = {r.work: r.n for r in state.groupBy("work").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert work.get(centroids.RESCANNED, 0) < 400 and work.get(centroids.CERTIFIED, 0) > 400
    assert state.selectExpr("max(size(near))").first()[0] <= 4


def test_assign_from_any_bounds():
    """Bounds that hold, however loose or tight, with ties and any number of stored centroids, give the nearest centroid."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        k = int(rng.integers(1, 12))
        b = min(int(rng.integers(0, 5)), k - 1)
        old = rng.integers(-3, 4, (k, 4))
        new = old + rng.integers(-1, 2, (k, 4)) * (rng.random((k, 1)) < 0.5)
        x = rng.integers(-4, 5, (200, 4))
        state = centroids.scan(x, old, b)
        less = int(rng.integers(0, b + 1))
        got = centroids.assign(x, state, new, np.sqrt(((new - old) ** 2).sum(1).astype(float)), less)
        assert (got["cluster"] == np.argmin(centroids.squares(x, new), axis=1)).all()
        assert got["near"].shape == (200, less)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        bisect.insort(gaps, (gaps.pop(at) if at < len(gaps) else capacity) - length)
    return len(gaps)


@pytest.mark.parametrize(("kind", "rows_per_task"), [("prose", 400), ("small", 500_000), ("thirds", 500_000), ("one length", 300), ("large", 500_000), ("full", 500_000), ("one", 500_000)])
def test_placing(spark, kind, rows_per_task):
    """Every piece once, no sequence over its capacity, and about as few as best-fit decreasing needs."""
    rng = np.random.default_rng(11)
    lengths = {
        "prose": np.clip(rng.lognormal(6.4, 1, 2000), 1, 2048), "small": rng.integers(1, 90, 3000), "thirds": rng.integers(600, 800, 1500), "one length": np.full(3000, 683),
        "large": rng.integers(900, 2049, 800), "full": np.full(50, 2048), "one": np.array([1]),
    }[kind].astype(int)
    pieces = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "rid long, length int")
    rows = packing.place(pieces, rows_per_task=rows_per_task).collect()
    assert sorted(r.rid for r in rows) == list(range(len(lengths)))
    held = Counter()
    for r in rows:
        held[r.bin] += r.length
    assert max(held.values()) <= 2048
    assert len(held) <= 1.02 * best_fit_decreasing(lengths, 2048) + 1


def test_matched_as_brackets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        slot = rng.random(int(rng.integers(1, 40))) < 0.5
        waiting, want = [], set()
        for i, s in enumerate(slot):
            if not s:
                waiting.append(i)
            elif waiting:
                want.add((waiting.pop(), i))
        assert set(zip(*[a.tolist() for a in packing.matched(slot)])) == want


def test_meetings_of_ranges():
    assert packing.meetings([(0, 2, 0), (1, 1, 3), (2, 0, 5)]) == [(0, 0, 2, 1, 0), (1, 0, 1, 2, 0)]
    assert packing.meetings([(0, 0, 4), (3, 5, 0), (4, 0, 2), (9, 1, 1)]) == [(3, 3, 5, 4, 0), (3, 2, 3, 9, 0)]


def test_packing_ids_and_offsets(edge, edge_rows, empty):
    """Ids of the tokenizers library, pieces cut at the front, sequences without gaps."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    want = []
    for i, t, *_ in edge_rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(repr(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = packing.pack(edge, path, public_tokenizers.PATTERN).collect()
    assert sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for at in map(sorted, sequences.values()):
        assert [o for o, _ in at] == [sum(n for _, n in at[:k]) for k in range(len(at))]
        assert sum(n for _, n in at) <= 2048
    assert packing.pack(empty, path, public_tokenizers.PATTERN).count() == 0


def test_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), packing.encoder(path, public_tokenizers.PATTERN)
    library.encode_special_tokens = True
    rng = random.Random(8)
    alphabet = "aeZß \t\n\r  'sdm12३中😀́<|endoftext|>.,-_​\x00"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>"])
        assert library.encode(text, add_special_tokens=False).ids == own.encode_ordinary(text)
