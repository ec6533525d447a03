"""Exact and near dedup against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tarnwatch.llm import common, components, exact_dedup, simhash


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(make, edge_rows, keep):
    rng = random.Random(1)
    rows = edge_rows[:4] + [(100 + i, f"text {rng.randint(0, 40)}", "en", "a") for i in range(300)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(make(rows), keep=keep, leaves=16, fan_in=4).collect()}
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    best = max if keep == "largest" else min
    for ids in groups.values():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (best(ids), len(ids), i == best(ids))
    assert len(got) == len(rows)


def test_exact_edges(edge, empty, edge_rows):
    assert exact_dedup.exact_groups(edge).count() == len(edge_rows)
    left = exact_dedup.drop_copies(edge)
    assert left.columns == edge.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in left.select("doc_id").collect()) == [(False, 2), (False, 4), (False, 5), (False, 6), (False, 7), (False, 8), (True, None)]
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def plain_fingerprint(text, words=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("file_rows", [2000, 4])
def test_components_are_those_of_all_pairs(make, edge_rows, prose, file_rows):
    rng = random.Random(3)
    rows = [r for r in edge_rows if r[0] is not None and r[0] != 5]
    for i in range(40):
        words = prose(400, i).split()
        for k in range(4):
            own = list(words)
            for _ in range(k):
                own[rng.randrange(400)] = "swapped"
            rows.append((100 + 4 * i + k, " ".join(own), "en", "a"))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(make(rows), file_rows=file_rows).collect()}
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    assert [got[r[0]]["fingerprint"] for r in rows] == [f"{p:016x}" for p in prints]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    roots = joined(len(rows), pairs)
    least = {}
    for k, r in enumerate(roots):
        least[r] = min(least.get(r, 1 << 60), rows[k][0])
    assert [got[r[0]]["component_id"] for r in rows] == [least[r] for r in roots]
    assert len(set(roots)) < len(rows) - 20


def test_near_edges(edge, empty, edge_rows):
    assert simhash.near_duplicates(edge).count() == len(edge_rows)
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.drop_near_copies(edge)
    assert left.columns == edge.columns and left.count() == 6  # equal texts, texts without words and repeated rows are one each
    assert simhash.drop_near_copies(empty).count() == 0


def test_near_copies_at_eight_tenths(make, prose):
    rng = random.Random(5)
    rows, alike = [], []
    for i in range(60):
        words = prose(300, 1000 + i).split()
        rows.append((2 * i, " ".join(words), "en", "a"))
        for _ in range(5 if i % 2 else 60):  # a few changes keep 0.8, many do not
            words[rng.randrange(300)] = "changed"
        rows.append((2 * i + 1, " ".join(words), "en", "a"))
        a, b = ({tuple(t.split()[k : k + 5]) for k in range(296)} for t in (rows[-2][1], rows[-1][1]))
        alike.append(len(a & b) / len(a | b) >= 0.8)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(make(rows)).collect()}
    found = [got[2 * i + 1] == 2 * i for i in range(60)]
    assert sum(alike) > 20
    assert not any(f and not a for f, a in zip(found, alike, strict=True))
    assert sum(f for f, a in zip(found, alike, strict=True) if a) >= 0.9 * sum(alike)


def test_repeats_of_a_passage_do_not_part_copies(make, prose):
    rows = []
    for i in range(20):
        body, passage = prose(300, 3000 + i), prose(40, 4000 + i)
        rows.append((2 * i, f"{body} {passage}", "en", "a"))
        rows.append((2 * i + 1, " ".join([body, *[passage] * 30]), "en", "a"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(make(rows)).collect()}
    assert [got[2 * i + 1] for i in range(20)] == [2 * i for i in range(20)]


def test_dense_group_loses_no_pair_to_closer_ones_that_fail(make, prose):
    rng = random.Random(11)
    template, texts = prose(400, 5000).split(), []
    for k in range(120):
        own = list(template)
        for at in rng.sample(range(80), 8):  # edits five words apart, of which two texts may share some
            own[5 * at] = f"own{at}"
        texts.append(" ".join(own))
    sets = [{tuple(w[k : k + 5]) for k in range(396)} for w in map(str.split, texts)]
    alike = [(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots = joined(120, alike)
    docs = make([(i, t, "en", "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs, plan=(12, 40)).collect()}
    found = sum(got[i] == got[j] for i, j in alike)
    assert len(alike) > 15 and found >= 0.97 * len(alike)
    within = {i: {got[j] for j in range(120) if roots[j] == roots[i]} for i in range(120)}
    assert sum(len(x) for x in {r: within[r] for r in set(roots)}.values()) == len(set(got.values()))  # no wrong link


@pytest.mark.parametrize("file_rows", [100, 20])
def test_names_with_partners_elsewhere(spark, file_rows):
    # Names 0..39 are of one label and one fingerprint, so none of them looks for another; 40..44 are of their own.
    rows = [(1, k, 100, 5, 5, 5, 5) for k in range(45)] + [(2, k, 100, 5, 5, 5, 5) for k in range(40)] + [(3, 50, 100, -1, 5, -1, 5), (3, 51, 100, 5, 5, 5, 5)]
    words = ["w0", "w1", "w2", "w3"]
    shared = spark.createDataFrame(rows, "file long, name long, size long, w0 long, w1 long, w2 long, w3 long")
    labels = spark.createDataFrame([(k, 0) for k in range(1, 40)], "name long, label long")
    got = simhash.open_names(shared, labels, words, 52, 0.8, file_rows)
    assert sorted(r["name"] for r in got.collect()) == list(range(45))  # 50 and 51 are too far apart
    assert 43 <= simhash.neighbour_pairs(shared, words, 52, 0.8).count() <= 44


@pytest.mark.parametrize("most_work", [2e9, 2e5])
def test_families_join_all_that_are_alike(spark, most_work):
    rng = random.Random(13)
    template, sets = list(range(100)), []
    for k in range(150):
        own = set(template) if k % 3 else set(rng.sample(range(1000, 1400), 90))
        for _ in range(rng.randint(0, 25)):
            own.discard(rng.choice(template))
            own.add(rng.randint(200, 600))
        sets.append(sorted(own))
    labels = [1 if k % 3 == 1 and k < 90 else k for k in range(150)]
    rows = spark.createDataFrame([(k // 75, k, labels[k], s) for k, s in enumerate(sets)], "family long, name long, label long, shingles array<long>")
    got = [(r["a"], r["b"]) for r in simhash.family_links(rows, 0.8, most_work).collect()]
    alike = {(i, j) for j in range(150) for i in range(j) if i // 75 == j // 75 and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    same = [(k, labels[k]) for k in range(150) if labels[k] != k]
    assert len(alike) > 50 and set(got) <= alike and len(got) < (150 if most_work > 1e9 else 1500)
    assert joined(150, same + got) == joined(150, same + sorted(alike))


@pytest.mark.parametrize("texts", [200, 42_000, 10**6, 10**10])
def test_file_plan_holds_recall_and_chance(texts):
    bits, tables = simhash.file_plan(texts)
    rng, n = np.random.default_rng(9), 400 if texts > 10**6 else 1000
    same, own = rng.standard_normal((n, 256)), rng.standard_normal((2, n, 256))
    x, y = (1000 * ((8 / 9) ** 0.5 * same + (1 / 9) ** 0.5 * o) for o in own)  # sets of one size at 0.8 have a cosine of 8/9
    kx, ky = simhash.file_keys(x, bits, tables), simhash.file_keys(y, bits, tables)
    met = [len(np.intersect1d(a, b)) > 0 for a, b in zip(kx, ky, strict=True)]
    assert sum(met) >= 0.97 * n
    assert all(len(set(k)) == 4 * tables for k in kx[:20].tolist())
    assert texts * 16 * tables / 2**bits <= 0.25  # rows that chance makes of each text


def test_sets_of_one_name_are_parted(spark):
    rows = spark.createDataFrame([(1, 11, 12, 5, 6, 70), (2, 13, 14, 5, 6, 70), (3, 15, 16, 5, 9, 71), (4, 17, 18, 8, 8, 72)], "__id long, mix long, mix2 long, name long, name2 long, size long")
    named, nodes = simhash.name_nodes(rows, ["size"])
    assert sorted((r["__id"], r["name"]) for r in named.collect()) == [(1, 5), (2, 5), (3, 9), (4, 8)]
    assert sorted((r["name"], r["__n"], r["size"]) for r in nodes.collect()) == [(5, 2, 70), (8, 1, 72), (9, 1, 71)]


def test_keys_and_repeats(spark, make):
    rows = [(1, "a|b", "en", "x"), (None, "t", "en", "x"), (7, "", None, "x"), (7, None, None, "y")] + [(2, "often", "en", "z")] * 100_000
    docs = make(rows)
    left = exact_dedup.drop_copies(docs)
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, "t"), (1, "a|b"), (2, "often"), (7, "")]
    key = spark.createDataFrame([("1|2", "3"), ("1", "2|3"), (None, "3"), ("null", "3")], "id string, p string").select(common.row_key("id", F.col("p")).alias("k"))
    assert key.distinct().count() == 4


@pytest.mark.parametrize("words", [1, 4])
def test_index_finds_all_pairs(words):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (30, words), dtype=np.uint64)
    codes = np.repeat(base, 10, axis=0)
    flips = rng.integers(0, 64, (300, 3))
    for k in range(3):
        codes[:, 0] ^= np.uint64(1) << flips[:, k].astype(np.uint64)
    index = simhash.GrayIndex(codes)
    i, j, apart = index.links(most=3)
    bits = np.bitwise_count(index.codes[:, None, :] ^ index.codes[None, :, :]).sum(axis=2)
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if bits[a, b] <= 3}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want
    assert all(bits[a, b] == d for a, b, d in zip(i, j, apart, strict=True))


def test_forest_spans():
    rng = np.random.default_rng(4)
    i, j = rng.integers(0, 50, 200), rng.integers(0, 50, 200)
    use = simhash.forest(50, i, j, rng.integers(0, 4, 200))
    assert joined(50, zip(i.tolist(), j.tolist(), strict=True)) == joined(50, zip(i[use].tolist(), j[use].tolist(), strict=True))
    assert len(use) == 50 - len(set(joined(50, zip(i.tolist(), j.tolist(), strict=True))))


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["a"]: r["b"] for r in components.stars(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500}
