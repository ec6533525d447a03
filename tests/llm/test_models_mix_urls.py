"""Models by held-out accuracy, mixing by its sums, URL lists by brute force."""

import random
import re
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.llm import language_id, mixing, quality, queries, toxicity, url_filter

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    m = queries.op2_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    h = m[m["held_out"]]
    hit = ((h["predicted"] == 1) & (h["toxic"] == 1)).sum()
    assert hit / (h["predicted"] == 1).sum() >= 0.9 and hit / (h["toxic"] == 1).sum() >= 0.7
    assert m["score"].between(0, 1).all()


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    dense = rng.random((300, 40)) * (rng.random((300, 40)) < 0.15)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    vectors = [(np.flatnonzero(v), v[np.flatnonzero(v)]) for v in dense]
    index = toxicity.BlockMaxIndex(vectors, 40, block=16)
    for q in range(50):
        n, s = index.nearest(*vectors[q], 10, leave=q)
        cos = dense @ dense[q]
        cos[q] = -1
        want = np.sort(cos)[::-1][: len(s)]
        assert np.allclose(s, want) and (len(s) == 10 or (np.sort(cos)[::-1][len(s)] <= 0))


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxicity_edges(spark, edge, empty, edge_rows):
    none = labels_of(spark, [])
    for labels in (none, labels_of(spark, [(1, 1, 1), (2, 1, 0), (2, 1, 1), (3, None, None)])):
        model = toxicity.fit(edge, labels, F.lit(True))
        assert toxicity.score(edge, model).count() == len(edge_rows)
    assert toxicity.score(empty, toxicity.fit(empty, none, F.lit(True))).count() == 0


def test_language_held_out(spark):
    m = queries.op8_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").toPandas()
    h = m[m["held_out"]]
    assert (h["lang_pred"] == h["lang"]).mean() >= 0.98 and m["score"].between(0, 1).all()


def test_language_edges(edge, empty, edge_rows):
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(edge, language_id.fit(edge, F.lit(True))).collect()}
    assert got[3] == got[4] == got[8] == "und" and got[1] in ("en", "fr", "de")
    assert language_id.identify(edge, language_id.fit(empty, F.lit(True))).count() == len(edge_rows)
    assert language_id.identify(empty, language_id.fit(empty, F.lit(True))).count() == 0


def test_quality_held_out(spark):
    m = queries.op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    h = m[m["held_out"]]
    assert (h["predicted"] == h["quality"]).mean() >= 0.95
    assert ((h["predicted"] == 1) & (h["quality"] == 1)).sum() / (h["quality"] == 1).sum() >= 0.97


def test_quality_scores_are_those_of_all_features_at_once(spark, make, edge_rows):
    """What comes back row by row against the model applied to the whole table in one place."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    rows = edge_rows + [(1000 + i, f"words {i} " * (i % 40), ("en", None, "de")[i % 3], ("a", "b", None)[i % 3]) for i in range(60)]
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score(make(rows), model).collect()}
    for i, text, lang, source in rows:
        t = text or ""
        z = 0.0
        for view, x, (a, b) in zip(model.views, (quality.content_features(t, model.buckets), quality.metadata_features(source, lang)), model.scales, strict=True):
            z += a * (sum(float(p) * float(q) for p, q in zip(x, view.w, strict=True)) + view.b) + b
        want = 1 / (1 + np.exp(-(model.last[0] * z + model.last[1])))
        assert abs(got[i][0] - want) < 1e-4 and got[i][1] == int(got[i][0] >= 0.5)


def test_no_view_can_be_rebuilt_from_the_other(spark, make, prose):
    """The content features of a text are the same whatever its metadata, and the other way round: what one view holds of a
    document says nothing certain of any feature of the other."""
    texts, places = [prose(n, n) for n in (3, 40, 400)] + [""], [("a", "en"), ("b", "en"), ("a", None), (None, "fr")]
    rows = [(len(places) * i + j, t, g, s) for i, t in enumerate(texts) for j, (s, g) in enumerate(places)]
    seen = {}
    for i, t, g, s in rows:
        seen[i] = (quality.content_features(t, 64).tobytes(), quality.metadata_features(s, g).tobytes())
    contents, metadata = {c for c, _ in seen.values()}, {m for _, m in seen.values()}
    assert len(contents) == len(texts) and len(metadata) == len(places)
    assert set(seen.values()) == {(c, m) for c in contents for m in metadata}


def test_language_scores_by_brute_force(spark, make, edge_rows):
    """Subword by subword in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, F.lit(True), buckets=512)
    rows = edge_rows[:4] + edge_rows[6:] + [(10_000 + r["doc_id"], r["text"], None, None) for r in docs.where("length(text) < 2000").limit(15).collect()]
    got = {r["doc_id"]: r for r in language_id.identify(make(rows), model).collect()}
    for i, text, *_ in rows:
        norm = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
        if not any(map(str.isalpha, norm)):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        raw, z, n = f" {norm} ".encode(), np.zeros(len(model.names)), 0
        for size in (2, 3, 4):
            for k in range(len(raw) - size + 1):
                h = 0
                for byte in raw[k : k + size]:
                    h = (h * 0x01000193 + byte) & 0xFFFFFFFF
                x = ((h ^ (size * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
                z, n = z + model.rows[(x ^ (x >> 15)) & 511], n + 1
        e = np.exp((z / n + model.bias) / model.temperature)
        p = e / e.sum()
        assert got[i]["lang_pred"] == model.names[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-6


def test_many_languages(make):
    rows = [(2 * k + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 5, f"l{k:04d}", "a") for k in range(1200) for j in (0, 1)]
    model = language_id.fit(make(rows), F.lit(True), buckets=256, epochs=1)
    assert len(model.names) == 1200


def test_toxicity_scores_by_brute_force(spark, make, edge_rows):
    """All examples scored for each text in plain numpy, without the index."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    dense = np.zeros((len(model.labels), len(model.vector.idf)))
    for b, (place, weights) in enumerate(model.index.postings):
        own = model.index.order[b * model.index.block : (b + 1) * model.index.block]
        for t in np.flatnonzero(place >= 0):
            dense[own, t] = weights[place[t]]
    texts = [(10_000 + r["doc_id"], r["text"], None, None) for r in docs.join(labels.where("toxic = 1"), "doc_id").select("doc_id", "text").limit(20).collect()]
    rows = edge_rows[:4] + edge_rows[6:] + texts
    got = {r["doc_id"]: r for r in toxicity.score(make(rows), model).collect()}
    for i, text, *_ in rows:
        at, v = model.vector(text or "")
        cos = np.round(dense[:, at] @ v, 12) if len(at) else np.zeros(len(dense))
        order = [n for n in np.lexsort((np.arange(len(cos)), -cos)) if cos[n] > 0][: model.k]
        vote = round(float(((cos[order] * model.labels[order]).sum() + model.pull * model.base) / (cos[order].sum() + model.pull)), 6)
        want = min(max(float(np.interp(vote, *model.knots)), 0.0), 1.0)
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_quality_edges(spark, edge, empty, edge_rows):
    for labels in (labels_of(spark, []), labels_of(spark, [(1, 1, 0), (4, 0, 0)])):
        assert quality.score(edge, quality.fit(edge, labels, F.lit(True))).count() == len(edge_rows)
    assert quality.score(empty, quality.fit(empty, labels_of(spark, []), F.lit(True))).count() == 0


def water(sizes):
    """Targets by resharing the excess, round by round."""
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        rest, w = total - sum(capped.values()), sum(weights[s] for s in free)
        new = {s: 3.0 * sizes[s] for s in free if rest * weights[s] / w > 3.0 * sizes[s] + 1e-9}
        if not new:
            return {**capped, **{s: rest * weights[s] / w for s in free}}
        capped |= new


@pytest.mark.parametrize("few", [50_000, 2])
def test_mixing(make, monkeypatch, few):
    rng = random.Random(8)
    sources = ["a", "b", "c", "d", "é", "Z", None, "tiny", "zero"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "en", rng.choice(sources[:7])) for i in range(600)]
    rows += [(1000, "w", "en", "tiny"), (1001, None, "en", "zero"), (1002, "", "en", "zero")]
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    if few == 2:
        real = mixing.with_source
        monkeypatch.setattr(mixing, "with_source", lambda a, b, salts, broadcast_rows=2: real(a, b, salts, 2))
    p = mixing.mix_plan(make(rows), salts=4).toPandas()
    want = water(sizes)
    taken = p.groupby(p["source"].fillna("~"))["taken"].sum()
    for s in sizes:
        own = p[p["source"].isna()] if s is None else p[p["source"] == s]
        assert (own["source_size"] == sizes[s]).all() and np.allclose(own["target"], want[s])
        assert abs(taken["~" if s is None else s] - want[s]) <= max(0.05 * want[s], 3)
    assert (p["taken"] <= 3 * p["size"]).all() and len(p) == len(rows)
    again = mixing.mix_plan(make(rows), salts=4).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == p.sort_values("doc_id")["taken"].tolist()
    mixed = mixing.mix(make(rows), salts=4)
    assert mixed.columns == make(rows).columns and mixed.count() == int(p["copies"].sum())


def test_mixing_edges(edge, empty, edge_rows):
    assert mixing.mix_plan(edge).count() == len(edge_rows)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


@pytest.mark.parametrize("few", [50_000, 1])
def test_url_lists(spark, few):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    entries = [("bad.example", "add", 10), ("bad.example", "remove", 20), ("ok.example/x", "add", 5), ("sub.bad.example", "add", 15), ("tie.example", "add", 3), ("tie.example", "remove", 3), (None, "add", 1), ("Bad.Example.", "add", 40)]
    e = spark.createDataFrame([(a, b, day(c)) for a, b, c in entries], "entry string, action string, at timestamp")
    deep = "http://ok.example/x/" + "y/" * 5000
    captures = [
        (12, deep, 9, "ok.example/x"), (13, "1|http://bad.example/", 12, None), (1, "http://bad.example/", 12, "bad.example"), (2, "https://a.sub.bad.example/p", 16, "sub.bad.example"), (3, "http://bad.example", 20, None), (4, "http://notbad.example", 12, None),
        (5, "http://u:p@OK.example:80/x/y?z", 9, "ok.example/x"), (6, "http://ok.example/xy", 9, None), (7, "http://tie.example", 4, None), (8, None, 12, None), (9, "nonsense", 12, None),
        (10, "http://bad.example", None, None), (11, "http://bad.example.", 41, "bad.example"), (1, "http://bad.example/", 12, "bad.example"),
    ]
    c = spark.createDataFrame([(i, u, day(d) if d is not None else None) for i, u, d, _ in captures], "page_id long, url string, fetched_at timestamp")
    got = sorted((r["page_id"], r["entry"] or "", r["blocked"]) for r in url_filter.filter_urls(c, e, broadcast_rows=few, salts=3).collect())
    assert got == sorted((i, w or "", w is not None) for i, _, _, w in captures)
    assert url_filter.filter_urls(c.limit(0), e).count() == 0 and url_filter.filter_urls(c, e.limit(0)).where("blocked").count() == 0


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        text = lambda x: str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)  # noqa: E731  longs with nulls may come as floats
        plain = lambda d: sorted(tuple(map(text, r)) for r in d[columns].astype(object).where(d[columns].notna(), None).values.tolist())
        assert plain(got) == plain(want), name


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = cp.run(spark, "/root/testdata/sf0.001")
    rows = got.select("doc_id", "exact").collect()
    assert rows and all(r["exact"] for r in rows)
    assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.collect()}
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]


def test_stages_on_edges(spark, edge, empty, tmp_path):
    import corpus_pipeline as cp

    labels_of(spark, [(1, 1, 1), (2, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (edge, empty):
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == edge.columns
        assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).where("NOT exact").count() == 0


def test_language_rows_that_repeat_with_nulls(make, prose):
    """A learned id again with a null text, another text or language: the smallest of those that are whole is learned."""
    rows = [(k, prose(12, k) if k % 2 else prose(12, k).upper()[::-1], "aa" if k % 2 else "bb", "s") for k in range(40)]
    again = [(1, None, "aa", "s"), (3, "zzz " * 9, "aa", "s"), (5, None, None, "s"), (7, "qqq", None, "s"), (None, None, "aa", "s")]
    model = language_id.fit(make([*rows, *again]), F.lit(True))
    assert model.names == ["aa", "bb"]
    changed = [r if r[0] != 3 else (3, min(r[1], "zzz " * 9), "aa", "s") for r in rows]
    assert np.allclose(language_id.fit(make(changed), F.lit(True)).rows, model.rows)


def test_many_languages_are_bounded(spark):
    """Junk codes do not grow the model or what the driver gets: the languages of most rows are learned."""
    junk = spark.range(50_000).selectExpr("id AS doc_id", "concat('text of ', id) AS text", "concat('x', id) AS lang", "'s' AS source")
    real = spark.range(50_000, 50_200).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'der und die das nicht', 'the and of that with') AS text", "IF(id % 2 = 0, 'de', 'en') AS lang", "'s' AS source")
    model = language_id.fit(junk.unionByName(real), F.lit(True), languages=20, epochs=5)
    assert len(model.names) == 20 and {"de", "en"} <= set(model.names) and model.rows.shape == (4096, 20)
