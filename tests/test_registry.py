"""Registry rules and the store on small made-up data."""

import base64
import json
from datetime import datetime, timedelta

from tarnwatch.operators import detectors as D
from tarnwatch.operators import registry as G
from tarnwatch.operators import windows as W
from tarnwatch.sinks import store

T0 = datetime(2024, 1, 1)


def test_typosquat_scores(spark):
    p = spark.createDataFrame([("loddash", 5, 10), ("expres", 900, 200_000), ("@x/lodash", None, None), ("@x/express", None, None), ("lodash", 1, 1), ("expr3ss", None, None)], "name string, age_days int, weekly_downloads int")
    t = spark.createDataFrame([("lodash", 1), ("express", 2)], "target string, ordinal int")
    got = {r["name"]: (r["target"], r["score"]) for r in G.typosquat(p, t, spark.createDataFrame([("lodash",)], "name string")).collect()}
    assert got == {"loddash": ("lodash", 100), "expres": ("express", 50), "@x/express": ("express", 80), "expr3ss": ("express", 75)}


def test_typosquat_broadcasts_no_packages(spark, tmp_path):
    """Packages in files that Spark takes for small, though each name has many keys, stay on the executors."""
    p = spark.range(500).selectExpr("concat('expres', id) AS name", "CAST(id AS INT) AS age_days", "CAST(id AS INT) AS weekly_downloads")
    p.write.parquet(f"{tmp_path}/p")
    t = spark.createDataFrame([("lodash", 1), ("express", 2)], "target string, ordinal int")
    j = G.typosquat(spark.read.parquet(f"{tmp_path}/p"), t, spark.createDataFrame([("lodash",)], "name string"))

    def sent(node):
        if node.nodeName().startswith("Broadcast"):
            yield (node.left() if node.buildSide().toString() == "BuildLeft" else node.right()).toString()
        for k in range(node.children().size()):
            yield from sent(node.children().apply(k))

    lists = list(sent(j._jdf.queryExecution().sparkPlan()))
    assert lists and not [x for x in lists if "parquet" in x]
    assert sorted(r["name"] for r in j.collect()) == sorted(f"expres{k}" for k in range(100))


def test_transitive(spark):
    d = spark.createDataFrame([("a", "loddash", "^1"), ("a", "x", "99.0.0"), ("b", "ok", "1.0.0")], "package string, dependency string, spec string")
    t = spark.createDataFrame([("lodash", 1)], "target string, ordinal int")
    assert [(r["package"], r["score"]) for r in G.transitive(d, t, "evil").collect()] == [("a", 60)]


def test_attestation(spark):
    digest = bytes(range(64))
    integrity = "sha512-" + base64.b64encode(digest).decode()

    def payload(name, hexed, repo):
        s = {"subject": [{"name": name, "digest": {"sha512": hexed}}], "predicate": {"buildDefinition": {"externalParameters": {"workflow": {"repository": repo}}}}}
        return base64.b64encode(json.dumps(s).encode()).decode()

    rows = [
        ("a", payload("pkg:npm/a@1", digest.hex(), "https://h.example/r"), "present"), ("b", payload("pkg:npm/x@1", digest.hex(), ""), "subject_mismatch"),
        ("c", payload("pkg:npm/c@1", "00", ""), "digest_unbound"), ("d", None, "none"), ("e", "e30=", "malformed"), ("f", payload("pkg:npm/f@1", digest.hex(), "https://h.example/other"), "repo_mismatch"),
    ]
    v = spark.createDataFrame([(n, "1", integrity, p, "git+https://h.example/r.git") for n, p, _ in rows], "package string, version string, integrity string, payload string, repository string")
    assert {r["package"]: r["kind"] for r in G.attestation(v).collect()} == {n: k for n, _, k in rows}


def test_extensions(spark):
    v = spark.createDataFrame([("e", "1", T0, 1000, ["a"]), ("e", "2", T0 + timedelta(days=1), 900_000, ["a", "*"])], "extension string, version string, published_at timestamp, asset_size long, activation_events array<string>")
    got = {r["version"]: (r["new_events"], r["size_delta"]) for r in G.extension_changes(v).collect()}
    assert got == {"1": ([], False), "2": (["*"], True)}
    h = spark.createDataFrame([("e", T0, "x"), ("e", T0 + timedelta(minutes=10), "y")], "extension string, ts timestamp, publisher string")
    assert G.quick_handover(h, "extension", "ts", "publisher", 15 * W.MINUTE).count() == 1


def test_spoofed_org(spark):
    f = spark.createDataFrame([("p", "AutoModel.from_pretrained('gooogle/bert'); x.from_pretrained('google/ok')")], "package string, content string")
    got = G.spoofed_orgs(f, spark.createDataFrame([("google",)], "target string")).collect()
    assert [(r["org"], r["target"]) for r in got] == [("gooogle", "google")]


def test_sibling_overlap(spark):
    b = spark.createDataFrame([("@s/a", T0, T0 + timedelta(hours=1)), ("@s/b", T0 + timedelta(minutes=30), T0 + timedelta(hours=2)), ("c", T0, T0)], "package string, from timestamp, until timestamp")
    assert [r["scope"] for r in G.sibling_overlap(b).collect()] == ["@s"]


def test_build_config(spark):
    f = spark.createDataFrame([("p", "binding.gyp", "'<!(node x)'"), ("q", "src/a.c", "system(\"x\"); getenv(\"Y\")"), ("r", "a.js", "system(")], "package string, path string, content string")
    assert {r["package"]: r["score"] for r in D.build_config(f).collect()} == {"p": 70, "q": 90}


def test_store(spark, tmp_path):
    s = spark.createDataFrame([(1, "p", T0), (2, "q", T0 + timedelta(days=1))], "scan_id int, package string, scanned_at timestamp")
    f = spark.createDataFrame([(1, "t", "d"), (2, None, "d")], "scan_id int, title string, description string")
    store.save_scans(s, f, str(tmp_path))
    assert [r["scan_id"] for r in store.recent(spark, str(tmp_path), 1).collect()] == [2]
    assert [r["description"] for r in store.findings_of(spark, str(tmp_path), [1]).collect()] == ["t"]
