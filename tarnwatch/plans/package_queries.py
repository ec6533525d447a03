"""Rules over packages, scripts and files, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.functions import signal_catalog as K
from tarnwatch.operators import campaigns as C
from tarnwatch.operators import detectors as D
from tarnwatch.operators import payloads as P
from tarnwatch.operators import registry as G
from tarnwatch.operators import rules as R
from tarnwatch.plans.package_data import CODE, REPUTABLE, WITH, count, files, has, hooks, listed, packages, pick, pick_sql, reputable, sql
from tarnwatch.sources.tables import table

#: Patterns that look ahead or back, as SQL that removes what must not follow, or spells the choice out.
_REWRITTEN = {
    r"bun\s+run(?!\s+test)": r"regexp_matches(regexp_replace(c, 'bun\s+run\s+test', '', 'g'), 'bun\s+run')",
    r"(?i)git\s+push.*--force(?!-with-lease)": r"regexp_matches(regexp_replace(c, '--force-with-lease', '', 'gi'), '(?i)git\s+push.*--force')",
}


def _plain(pattern: str) -> str:
    """The same pattern without a reference back to an opening quote."""
    if pattern.endswith(r"\1"):
        inner = pattern.replace(r"([\"'])", "", 1)[:-2]
        flag, body = inner[:4], inner[4:]
        return f"{flag}\"{body}\"|'{body}'"
    return pattern


def _catalog_sql(given: str | None = None) -> str:
    """Each signal per file or script, summed (or found) per package, weighed and banded."""
    counts, found = [], []
    for d, (name, det) in enumerate(K.CONTENT.items()):
        ext = "n" if name in ("D15-MEMORY-EXTRACTION", "D16-EBPF-ROOTKIT", "D17-PRIVILEGE-ESCALATION") else "s"
        kind = "kind IN ('code', 'script')" if name.startswith("D24") else "kind = 'code'"
        total, fired = [], []
        for k, (signal, (weight, patterns)) in enumerate(det.signals.items()):
            reads = "kind = 'install'" if signal == "bpf_syscall" else f"({kind} AND (kind <> 'code' OR {ext}))"
            if det.mode == "each":
                n, agg = count("c", *patterns), "sum"
            else:
                n, agg = "CAST((" + " OR ".join(_REWRITTEN.get(p) or f"regexp_matches(c, {sql(_plain(p))})" for p in patterns) + ") AS INT)", "max"
            limit = f"least(3, {agg}(CASE WHEN {reads} THEN {n} ELSE 0 END))" if signal == "exploit_reference" else f"{agg}(CASE WHEN {reads} THEN {n} ELSE 0 END)"
            counts.append(f"{limit} AS x{d}_{k}")
            total.append(f"x{d}_{k} * {weight}")
            fired.append(f"CASE WHEN x{d}_{k} > 0 THEN '{signal}' END")
        found.append(f"SELECT package, '{name}' AS detector, {' + '.join(total)} AS raw, concat_ws(',', {', '.join(fired)}) AS signals, {det.flag} AS flag, {det.warn} AS warn FROM x")
    texts = given or WITH + """, texts AS (SELECT package, content AS c, 'code' AS kind, regexp_matches(path, '(?i)\\.(js|mjs|cjs|ts)$') AS s, regexp_matches(path, '(?i)\\.(js|mjs|cjs|ts|rs|c|cc|cpp|h|hpp)$') AS n FROM files
  UNION ALL SELECT package, body, 'script', false, false FROM hooks
  UNION ALL SELECT package, body, 'install', false, false FROM hooks WHERE hook IN ('postinstall', 'install'))"""
    return texts + f""",
x AS (SELECT package, {', '.join(counts)} FROM texts GROUP BY package), f AS ({' UNION ALL '.join(found)})
SELECT package, detector, CAST(raw AS INT) AS raw_score, CAST(least(raw, 100) AS INT) AS score, signals,
  CASE WHEN least(raw, 100) >= flag THEN 'critical' WHEN least(raw, 100) >= warn THEN 'high' WHEN raw >= 30 THEN 'medium' ELSE 'low' END AS severity FROM f WHERE raw > 0"""


def _catalog(s, d):
    found = D.all_weighted(files(s, d), K.CONTENT, path="path", scripts=hooks(s, d))
    return found.withColumn("signals", F.array_join("signals", ","))


def _code_in(name, text, key):
    """A table's texts, each with a line of code behind it."""
    def query(s, d):
        t = table(s, d, name).select(F.col(key).alias("package"), F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), pick(CODE, key)).alias("content"))
        return D.all_weighted(t, K.CONTENT).withColumn("signals", F.array_join("signals", ","))

    return query


def _code_in_sql(name, text, key):
    return _catalog_sql(f"WITH texts AS (SELECT {key} AS package, coalesce({text}, '') || chr(10) || {pick_sql(CODE, key)} AS c, 'code' AS kind, true AS s, true AS n FROM {name})")


def _facts(name, two=True):
    from tarnwatch.operators import code_facts

    f = getattr(code_facts, name)

    def query(s, d):
        own = packages(s, d).select("package", "scripts", F.lit("f1/index.js").alias("main"))
        found = f(files(s, d), own) if two else f(files(s, d))
        return found.withColumn("signals", F.array_join("signals", ","))

    return query


def _spoof(s, d):
    """Addresses of a package's metadata; a version before it by its key."""
    from tarnwatch.functions import text as T

    p = packages(s, d)
    before = F.concat((F.col("id") % 3).cast("string"), F.lit("."), (F.col("id") % 5).cast("string"), F.lit(".0"))
    inflated = T.inflation(F.col("version"), before, F.col("id") % 30).isNotNull()
    return D.metadata_spoof(p.select("package", F.array("repository", F.when(F.col("id") % 4 == 0, "http://docs.corp/x").otherwise("https://example.org")).alias("urls"), inflated.alias("inflated")))


def _texts(s, d):
    """One line of code or prose per line item."""
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", pick(CODE, "l_orderkey + l_linenumber * 5").alias("content"))


def _all_texts(s, d):
    """Scripts and code files."""
    return hooks(s, d).select("package", F.col("body").alias("content")).unionByName(files(s, d).where(F.col("path").rlike(D.SCRIPTED)).select("package", "content"))


BINARY_PATHS = [
    "bin/tool-linux-x64", "bin/tool-darwin-arm64", "lib/tool", "build/addon.node", "native/x", "python3.sh", "lib/code.js", "dist/app.exe", "a/b.o", "run-win32-x64.exe", "docs/Deno", "src/main.c",
]
BINARY_OWNERS = ["tool", "esbuild", "left", "react", "addon", "bare"]
BINARY_MAGIC = ["7F454C4602", "4D5A9000", "0061736D01", "FEEDFACF00", "CAFEBABE00", "23212F62", "7F45", ""]


def _binary_embed(s, d):
    """Parts are files of packages, eight parts each, and every package is listed by its first part."""
    p = table(s, d, "part")
    own = F.expr("p_partkey div 8")
    package = F.concat(pick(BINARY_OWNERS, "p_partkey div 8"), F.when(own % 6 == 1, "").otherwise(own.cast("string")))
    magic = F.unhex(pick(BINARY_MAGIC, "p_partkey * 5 + p_size"))
    f = p.select(package.alias("package"), F.concat(pick(BINARY_PATHS, "p_partkey * 7 + p_size"), F.when(F.col("p_size") % 4 == 0, ".dll").otherwise("")).alias("path"), magic.alias("bytes"))
    first = p.where("p_partkey % 8 = 0 AND p_partkey div 8 % 6 <> 1")
    m = first.select(
        package.alias("package"), F.when(F.col("p_size") % 5 == 0, "tool").alias("bin_name"), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("./bin/tool-linux-x64"), F.lit("x"))).alias("bin"),
        F.when(F.col("p_size") % 7 == 0, F.array(F.lit("app.exe"))).alias("optional"), (F.col("p_size") % 2 == 0).alias("gyp"))
    code = first.select(package.alias("package"), pick(["spawn ('x')", "fs.chmod (a)", "respawn", "go()"], "p_size").alias("content"))
    return D.binary_embed(f, m, code, s.createDataFrame([("bare5",), ("bare11",)], "name string"))


def _source_tree(s, d):
    """The files as a source tree has them: every fifth is absent, every seventh was changed, line ends differ."""
    f = files(s, d).where("id % 5 <> 0")
    return f.select("package", "path", "id", F.when(F.col("id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.concat(F.replace("content", F.lit("\n"), F.lit("  \r\n")), F.lit(" "))).alias("content"))


def _campaign(rule, stop=None):
    def query(s, d):
        return R.campaign(rule(packages(s, d), files(s, d)), stop).select("package", "version", F.concat_ws(",", "rules").alias("rules"), "severity")

    return query


def _hijacked(s, d):
    p = packages(s, d).withColumn("package", F.when(F.col("id") == 7, "node-ipc").otherwise(F.col("package"))).withColumn("version", F.when(F.col("id") == 7, "9.1.6").otherwise(F.col("version")))
    p = p.withColumn("publisher", F.when(F.col("id") == 7, "atiertant").otherwise(F.col("publisher")))
    hashes = files(s, d).where("id % 40 = 0").select(F.sha2("content", 256).alias("sha256"))
    return R.campaign(C.hijacked_module(p, files(s, d), hashes)).select("package", "version", F.concat_ws(",", "rules").alias("rules"), "severity")


def _desync(s, d):
    one = lambda df: df.groupBy("package", "path").agg(F.min_by("content", "id").alias("content"))
    return D.tarball_desync(one(files(s, d)), one(_source_tree(s, d)))


def _follow(s, d):
    one = files(s, d).select("package", F.regexp_replace("path", r"^f\d/", "").alias("path"), "content", "id").groupBy("package", "path").agg(F.min_by("content", "id").alias("content"))
    return D.follow_hooks(packages(s, d), one).select("package", "hook", F.array_join("chain", ">").alias("chain"))


def _pairs(s, d):
    path = F.concat(F.lit("m"), (F.col("id") % 3).cast("string"), F.when(F.col("size") % 2 == 0, ".cjs").otherwise(".mjs"))
    f = files(s, d).select("package", path.alias("path"), (F.col("size") * 2000).alias("size"))
    return D.content_size_pairs(f).select("package", "stem", "cjs", "mjs")


def _worst(s, d):
    return R.worm(hooks(s, d).select("package", "body"))


def _code_rules(s, d):
    return R.code_rules(files(s, d))


QUERIES = {
    "signal_catalog_packages": _catalog,
    "signal_catalog_docs": _code_in("documents", "text", "doc_id"),
    "signal_catalog_pages": _code_in("pages", "html", "page_id"),
    "dropper": _facts("dropper"),
    "runtime_evasion": _facts("runtime_evasion"),
    "workspace_persistence": _facts("workspace_persistence", False),
    "lifecycle_hooks": lambda s, d: D.lifecycle_rule(packages(s, d), reputable(s, d)),
    "multistage_hooks": lambda s, d: D.multistage(packages(s, d)).select("package", "hook", "score"),
    "metadata_spoof": _spoof,
    "hidden_payload": lambda s, d: P.hidden_payload(files(s, d), packages(s, d)),
    "infostealer": lambda s, d: P.infostealer(files(s, d), packages(s, d), reputable(s, d)),
    "repository_mismatch": lambda s, d: P.repository_mismatch(
        packages(s, d).withColumn("package", F.when(F.col("id") % 3 == 0, pick(REGISTERED_NAMES, "id")).otherwise(F.col("package"))), files(s, d)).distinct(),
    "atk_manifest_rules": lambda s, d: R.manifest_rules(packages(s, d)),
    "atk_code_rules": _code_rules,
    "encrypted_c2": lambda s, d: R.encrypted_c2(files(s, d)),
    "prompt_injection": lambda s, d: R.prompt_injection(_texts(s, d), ["l_orderkey", "l_linenumber"], "content"),
    "obfuscation_score": lambda s, d: D.obfuscation(files(s, d), "id", "content"),
    "build_config": lambda s, d: D.build_config(files(s, d)).withColumn("signals", F.array_join("signals", ",")),
    "worm_hooks": _worst,
    "cloud_metadata": lambda s, d: R.cloud_metadata(_all_texts(s, d)),
    "binary_embed": _binary_embed,
    "hook_followthrough": _follow,
    "tarball_desync": _desync,
    "module_size_pairs": _pairs,
    "campaign_trapdoor": _campaign(lambda p, f: C.trapdoor(p, f, "2024-02-01")),
    "campaign_poisoned_client": _campaign(C.poisoned_client, "D1"),
    "campaign_copied_names": _campaign(C.copied_names, "D1S"),
    "campaign_scrambled_worm": _campaign(C.scrambled_worm, "D1"),
    "campaign_hijacked_module": _hijacked,
    "model_references": lambda s, d: G.model_references(_all_texts(s, d)),
    "paas_domains": lambda s, d: files(s, d).select("id", F.array_join(P.paas_domains(F.col("content")), ",").alias("domains")).where("domains <> ''"),
}

REGISTERED_NAMES = ["lodash", "react", "chalk", "glob", "@x/debug", "uuid", "semver"]

_RUNS = r"\beval\s*\(|\bFunction\s*\(|\(0,\s*eval\)\s*\("
_ENTROPY = "coalesce(list_aggregate(string_split({0}, ''), 'entropy'), 0)"
_NAMES = r"\b[a-zA-Z_$][\w$]*\b"


def _mean_name(c: str) -> str:
    return f"(len(array_to_string(regexp_extract_all({c}, {sql(_NAMES)}), '')) / nullif(len(regexp_extract_all({c}, {sql(_NAMES)})), 0))"


def obfuscated_sql(c: str) -> str:
    call = r"^[a-zA-Z_$][\w$]*\([^)]*\)$"
    hexed = r"0x[0-9a-fA-F]{2,}|\\x[0-9a-fA-F]{2}"
    b64 = "['\"`][A-Za-z0-9+/]{20,}={0,2}['\"`]"
    return f"""(length({c}) > 0 AND ((NOT regexp_matches(trim({c}), '\\s') AND (coalesce({_mean_name(c)} < 3, false) OR regexp_matches(trim({c}), {sql(call)})))
  OR {has(c, hexed)} OR {has(c, b64)} OR {_ENTROPY.format(c)} > 5.5))"""


_HOST = "coalesce(nullif(regexp_extract(u, '^(?:[a-z+]+://)?(?:[^@/]*@)?([^/\\s:]+)', 1), ''), '')"
_ID = r"AKIA[0-9A-Z]{16}"

ORACLE = {
    "signal_catalog_packages": _catalog_sql(),
    "signal_catalog_docs": _code_in_sql("documents", "text", "doc_id"),
    "signal_catalog_pages": _code_in_sql("pages", "html", "page_id"),
    "lifecycle_hooks": WITH + f""", h AS (SELECT package, hook, {has('body', _RUNS)} AS runs, {obfuscated_sql('body')} AS hidden,
    {has('body', r'(?i)\b(?:curl|wget|powershell|bash|sh)\b', r'\b(?:exec|execSync|spawn|spawnSync|fork)\s*\(')} AS net,
    {has('body', "(?i)https?://([^'\"\\s)\\]]+)", r'\b(?:\d{1,3}\.){3}\d{1,3}\b')} AS address, {has('body', r'(?i)(?:github-ent|jira\.internal|docs\.internal)')} AS internal,
    {has('body', r'process\.env\.(?:AWS_[A-Z_]+|NPM_TOKEN|NPM_AUTH_TOKEN|GIT_TOKEN|SSH_KEY)')} AS env, NOT {has('body', r'\brequire\s*\(')} AS silent
  FROM hooks WHERE (hook IN ('postinstall', 'preinstall', 'install', 'prepare', 'preuninstall', 'postuninstall') OR hook LIKE 'pre%' OR hook LIKE 'post%')
    AND package NOT IN (SELECT unnest({listed(REPUTABLE)}))),
b AS (SELECT *, greatest(CASE WHEN runs OR (hidden AND net) THEN 90 ELSE 0 END, CASE WHEN address AND internal THEN 90 WHEN address THEN 70 ELSE 0 END, CASE WHEN env THEN 90 ELSE 0 END) AS base FROM h)
SELECT package, hook, CAST(CASE WHEN silent THEN least(100, round(base * 2.5)) ELSE base END AS INT) AS score, CASE WHEN base = 90 THEN 'critical' ELSE 'high' END AS severity FROM b WHERE base > 0""",
    "multistage_hooks": WITH + f""", h AS (SELECT package, hook, {has('body', r'\b(?:fetch|axios\.get|axios\.post|http\.get|https\.get)\(|\b(?:curl|wget)\s')}
    AND {has('body', r'\b(?:execFile|execFileSync|execSync|exec|spawnSync|spawn)\s*\(')} AS a, {has('body', r'detached\s*:\s*true')} AS b
  FROM hooks WHERE hook IN ('preinstall', 'install', 'postinstall', 'prepare'))
SELECT package, hook, CASE WHEN a AND b THEN 95 WHEN a THEN 82 ELSE 78 END AS score FROM h WHERE a OR b""",
    "metadata_spoof": WITH + f""", v AS (SELECT package, id, list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) AS v,
    [repository, CASE WHEN id % 4 = 0 THEN 'http://docs.corp/x' ELSE 'https://example.org' END] AS urls FROM packages),
n AS (SELECT package, len(list_filter(list_transform(urls, lambda u: {_HOST}), lambda h: regexp_matches(h, '(?i)\\.(internal|local|corp|intra|priv|lan)([.:/]|$)')
    OR regexp_matches(h, '(?i)github-ent|jira-ent|github\\.enterprise|internal-gitlab|gitlab\\.internal|jenkins\\.internal|confluence\\.internal')
    OR regexp_matches(h, '^(?:10\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}|172\\.(?:1[6-9]|2\\d|3[01])\\.\\d{{1,3}}\\.\\d{{1,3}}|192\\.168\\.\\d{{1,3}}\\.\\d{{1,3}})'))) AS n,
    id % 30 >= 7 AND (v[1] - id % 3 > 10 OR v[2] - id % 5 > 20 OR v[3] > 50) AS jump FROM v)
SELECT package, CAST(CASE WHEN n > 0 THEN greatest(50, least(90, round((65 + CASE WHEN n > 1 THEN 20 ELSE 0 END) * CASE WHEN jump THEN 1.3 ELSE 1 END))) ELSE 50 END AS INT) AS score FROM n WHERE n > 0 OR jump""",
    "repository_mismatch": WITH + f""", p AS (SELECT CASE WHEN id % 3 = 0 THEN {pick_sql(REGISTERED_NAMES, 'id')} ELSE package END AS package, repository FROM packages WHERE repository <> ''),
r AS (SELECT package, repository, lower(regexp_extract(repository, 'github\\.com[/:]([\\w.-]+/[\\w.-]+?)(?:\\.git)?$', 1)) AS repo, lower(regexp_extract(package, '([^/]+)$', 1)) AS short FROM p),
known AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in P.KNOWN_REPOSITORIES.items())}) t(name, home)),
said AS (SELECT package, unnest(regexp_extract_all(content, '(?i)//\\s*Source:\\s*(https?://[^\\s]+)', 1)) AS said FROM files)
SELECT DISTINCT package, 'ATK-008' AS atk_id, 'high' AS severity, repo || ' for ' || home AS evidence FROM r JOIN known ON name = short WHERE repo <> '' AND split_part(repo, '/', 2) <> short AND home <> repo
UNION SELECT DISTINCT s.package, 'ATK-008', 'medium', said FROM said s JOIN r ON s.package = r.package WHERE NOT contains(r.repository, lower(regexp_extract(said, '^https?://([^/:?#]+)', 1)))""",
    "atk_manifest_rules": WITH + """, b AS (SELECT package, string_agg(body, ' ' ORDER BY CASE hook WHEN 'test' THEN 1 ELSE 0 END) AS body FROM hooks WHERE regexp_matches(hook, '(?i)pre|post|install') GROUP BY package)
SELECT package, 'ATK-001' AS id, 'high' AS severity, body AS evidence FROM b WHERE regexp_matches(body, '(?i)curl|wget|sh |bash |\\.sh|exfil|steal|pwn|c2|pastebin')
UNION ALL SELECT package, 'ATK-006', 'medium', dependency FROM packages WHERE regexp_matches(dependency, '(?i)squat|confus|typo')""",
    "encrypted_c2": WITH + f""", n AS (SELECT package, {count('content', R.C2['known_endpoint'][1])} AS a, {count('content', R.C2['onion'][1])} AS b, {count('content', R.C2['encoded_url'][1])} AS c, {count('content', R.C2['hex_domain'][1])} AS d,
    {has('content', '(?i)session|oxen|filev2|getsession')} AS se, {has('content', '(?i)signal')} AS si, {has('content', '(?i)briar')} AS br FROM files),
g AS (SELECT package, sum(a * 80 + b * 30 + c * 35 + d * 35) AS w, sum(a + b + c + d) AS n, bool_or(se) OR bool_or(si) AS s, bool_or(br) AS r FROM n GROUP BY package),
t AS (SELECT package, least(100, CASE WHEN n > 0 THEN least(w, 80) + 20 + CASE WHEN n > 1 THEN least(n * 5, 15) ELSE 0 END ELSE 20 END + CASE WHEN s THEN 20 ELSE 0 END + CASE WHEN r THEN 15 ELSE 0 END) AS score FROM g)
SELECT package, CAST(score AS INT) AS score FROM t WHERE score >= 50""",
    "prompt_injection": "WITH t AS (SELECT l_orderkey, l_linenumber, " + pick_sql(CODE, "l_orderkey + l_linenumber * 5") + " AS c FROM lineitem)\n" + "\nUNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{g}' AS \"group\", {w} AS score, '{sev}' AS severity, left(unnest(regexp_extract_all(c, {sql(p)}, 0)), 120) AS match FROM t" for g, (w, sev, ps) in R.INJECTION.items() for p in ps),
    "worm_hooks": WITH + f""", n AS (SELECT package, sum({' + '.join(f'{count("body", p)} * {w}' for w, p in R.WORM.values())}) AS raw FROM hooks GROUP BY package)
SELECT package, CAST(least(raw, 100) AS INT) AS score FROM n WHERE raw > 0""",
    "cloud_metadata": WITH + """, t AS (SELECT package, body AS c, 'h' || hook AS id FROM hooks UNION ALL SELECT package, content, CAST(id AS VARCHAR) FROM files WHERE regexp_matches(path, '(?i)\\.(js|mjs|cjs|ts)$')),
l AS (SELECT package, id, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1) AS no FROM t),
g AS (SELECT DISTINCT package FROM t WHERE contains(c, 'metadata.google.internal') OR contains(c, 'computeMetadata/v1')),
z AS (SELECT package FROM t WHERE contains(c, '169.254.169.254/metadata/instance') OR contains(c, '169.254.169.254/metadata/identity')
  UNION SELECT a.package FROM l a JOIN l h ON a.package = h.package AND a.id = h.id AND abs(a.no - h.no) <= 5 WHERE contains(a.line, '169.254.169.254') AND regexp_matches(h.line, '(?i)Metadata\\s*:\\s*true'))
SELECT coalesce(g.package, z.package) AS package, CASE WHEN g.package IS NOT NULL AND z.package IS NOT NULL THEN 92 ELSE 82 END AS score,
  CASE WHEN g.package IS NULL THEN 'azure_imds' WHEN z.package IS NULL THEN 'gcp_metadata' ELSE 'multi_cloud_imds' END AS subtype, 'high' AS severity FROM g FULL JOIN z ON g.package = z.package""",
    "binary_embed": f"""WITH f AS (SELECT p_partkey // 8 AS own, {pick_sql(BINARY_OWNERS, 'p_partkey // 8')} || CASE WHEN p_partkey // 8 % 6 = 1 THEN '' ELSE CAST(p_partkey // 8 AS VARCHAR) END AS package,
  {pick_sql(BINARY_PATHS, 'p_partkey * 7 + p_size')} || CASE WHEN p_size % 4 = 0 THEN '.dll' ELSE '' END AS path, {pick_sql(BINARY_MAGIC, 'p_partkey * 5 + p_size')} AS m FROM part),
m AS (SELECT p_partkey // 8 AS own, p_size % 5 = 0 AS named, p_size % 3 = 0 AS mapped, p_size % 7 = 0 AS optional, p_size % 2 = 0 AS gyp, p_size % 4 IN (0, 1) AS started FROM part WHERE p_partkey % 8 = 0 AND p_partkey // 8 % 6 <> 1),
k AS (SELECT *, string_split(path, '/')[-1] AS base, regexp_matches(path, '(^|/)(bin|native)/') AS dir,
  CASE WHEN m LIKE '7F454C46%' THEN 'elf' WHEN m LIKE '4D5A%' THEN 'pe' WHEN m LIKE '0061736D%' THEN 'wasm' WHEN m LIKE 'FEEDFACF%' THEN 'mach-o' WHEN m LIKE 'CAFEBABE%' THEN 'fat' END AS kind,
  string_split(regexp_replace(path, '(?i)-(linux|darwin|macos|win32|windows|win)-(x64|x86|arm64|ia32)\\.?(exe)?$', ''), '/')[-1] AS stem FROM f WHERE package NOT IN ('esbuild', 'bare5', 'bare11')),
b AS (SELECT * FROM k WHERE kind IS NOT NULL OR dir OR regexp_matches(path, '(?i)\\.(exe|dll|so|dylib|wasm|node|o|a)$')
  OR lower(regexp_replace(base, '\\.\\w+$', '')) IN ('bun', 'deno', 'go', 'rustc', 'python', 'python3', 'ruby', 'php')),
sets AS (SELECT own, arg_min(stem, first) AS stem FROM (SELECT own, stem, min(path) AS first FROM b GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY own),
s AS (SELECT b.*, sets.stem IS NOT NULL AS crossed, coalesce(m.started, false) AS started,
  coalesce((m.named AND base = 'tool') OR (m.mapped AND base IN ('tool-linux-x64', 'x')) OR (m.optional AND base = 'app.exe') OR (m.gyp AND ends_with(base, '.node')), false) AS declared
  FROM b LEFT JOIN m ON b.own = m.own LEFT JOIN sets ON b.own = sets.own AND b.stem = sets.stem),
t AS (SELECT *, greatest(50, least(100, CASE WHEN kind <> 'wasm' THEN 95 ELSE 60 END + CASE WHEN crossed THEN 25 ELSE 0 END + CASE WHEN dir THEN 15 ELSE 0 END + CASE WHEN declared THEN 0 ELSE 50 END + CASE WHEN started THEN 25 ELSE 0 END)) AS score FROM s)
SELECT package, path, score, CASE WHEN crossed THEN 'cross_platform_' || coalesce(kind, 'unknown') ELSE coalesce(kind || '_embedded', 'magic_byte_unknown') END AS subtype,
  CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 THEN 'high' ELSE 'medium' END AS severity FROM t""",
    "hook_followthrough": WITH + """, one AS (SELECT package, regexp_replace(path, '^f\\d/', '') AS path, arg_min(content, id) AS content FROM files GROUP BY 1, 2),
first AS (SELECT h.package, hook, path, content FROM (SELECT package, hook, regexp_extract(body, '(?:node|sh|bash|python3?)\\s+(?:\\./)?([\\w./-]+)', 1) AS path FROM hooks
    WHERE hook IN ('install', 'prepare') OR hook LIKE 'pre%' OR hook LIKE 'post%') h JOIN one USING (package, path)),
need AS (SELECT DISTINCT package, hook, path AS first, unnest(regexp_extract_all(content, 'require\\s*\\(\\s*[''"](?:\\./)?([\\w./-]+)[''"]', 1)) AS r FROM first)
SELECT package, hook, path AS chain FROM first UNION ALL
SELECT n.package, hook, first || '>' || path FROM need n JOIN one ON one.package = n.package AND one.path = CASE WHEN regexp_matches(r, '\\.\\w+$') THEN r ELSE r || '.js' END""",
    "tarball_desync": WITH + """, own AS (SELECT package, path, arg_min(content, id) AS content FROM files GROUP BY 1, 2),
theirs AS (SELECT package, path, arg_min(content || CASE WHEN id % 7 = 0 THEN '!' ELSE '' END, id) AS content FROM files WHERE id % 5 <> 0 GROUP BY 1, 2)
SELECT o.package, o.path, CASE WHEN t.content IS NULL THEN 'absent_from_source' ELSE 'modified' END AS kind FROM own o LEFT JOIN theirs t USING (package, path) WHERE t.content IS NULL OR t.content <> o.content""",
    "module_size_pairs": WITH + """, m AS (SELECT package, 'm' || CAST(id % 3 AS VARCHAR) AS stem, max(CASE WHEN size % 2 = 0 THEN size * 2000 END) AS cjs, max(CASE WHEN size % 2 = 1 THEN size * 2000 END) AS mjs
  FROM files GROUP BY 1, 2) SELECT * FROM m WHERE abs(cjs - mjs) > 51200""",
    "model_references": WITH + """, t AS (SELECT package, body AS c FROM hooks UNION ALL SELECT package, content FROM files WHERE regexp_matches(path, '(?i)\\.(js|mjs|cjs|ts)$')),
r AS (SELECT package, unnest(regexp_extract_all(c, '(?:huggingface\\.co|hf\\.co)/([^/\\s"''>]+/[^/\\s"''>]+)', 1)) AS r FROM t
  UNION SELECT package, unnest(regexp_extract_all(c, 'from_pretrained\\(\\s*["'']([^"'']+/[^"'']+)["'']', 1)) FROM t
  UNION SELECT package, unnest(regexp_extract_all(c, 'hub\\.download\\(\\s*["'']([^"'']+/[^"'']+)["'']', 1)) FROM t
  UNION SELECT package, a[1] || '/' || a[2] FROM (SELECT package, unnest(list_zip(regexp_extract_all(c, 'hub\\.download\\(\\s*["'']([^"'']+)["'']\\s*,\\s*["'']([^"'']+)["'']', 1),
    regexp_extract_all(c, 'hub\\.download\\(\\s*["'']([^"'']+)["'']\\s*,\\s*["'']([^"'']+)["'']', 2))) AS a FROM t))
SELECT DISTINCT package, split_part(r, '/', 1) AS org, split_part(r, '/', -1) AS model FROM r""",
    "paas_domains": WITH + f"""SELECT id, array_to_string(list_distinct(regexp_extract_all(content, {sql(P.PAAS)}, 1)), ',') AS domains FROM files WHERE {has('content', P.PAAS)}""",
    "infostealer": WITH + f""", f AS (SELECT package, path, content, regexp_extract_all(content, {sql(P.ADDRESS)}, 1) AS urls FROM files),
s AS (SELECT package, path, CASE WHEN {has('content', 'AKIA[0-9A-Z]{16}')} THEN 'cred_regex_aws' WHEN {has('content', 'npm_[a-zA-Z0-9]{36}')} THEN 'cred_regex_npm_token' WHEN {has('content', 'ghp_[a-zA-Z0-9]{30,40}')} THEN 'cred_regex_gh_token' END AS secret,
  CASE WHEN {has('content', P.FS_READ)} AND {has('content', P.HTTP_FETCH, P.CHILD_PROCESS, P.FETCH_TOOLS)} THEN CASE WHEN len(list_filter(urls, lambda d: contains(lower(d), 'github.com') AND NOT regexp_matches(lower(d), 'npmjs\\.(?:com|org)'))) > 0
      AND len(list_filter(urls, lambda d: NOT contains(lower(d), 'github.com') AND NOT regexp_matches(lower(d), 'npmjs\\.(?:com|org)'))) = 0 THEN 'nw_exfil_to_github' ELSE 'fs_exfil' END
    WHEN {has('content', P.ENV_DUMP)} THEN 'env_dump' WHEN {has('content', P.IDENTITY, P.GIT_CONFIG)} THEN 'identity_recon_exfil' END AS other,
  coalesce({_mean_name('content')} < 3, false) OR {_ENTROPY.format('content')} > 5.5 OR {has('content', r'\beval\s*\(', r'\bFunction\s*\(')} AS hidden, {has('content', P.PAAS)} AS paas FROM f),
g AS (SELECT package, arg_min(secret, path) FILTER (secret IS NOT NULL) AS secret, arg_min(other, path) FILTER (other IS NOT NULL) AS other, bool_or(hidden) AS hidden, bool_or(paas) AS paas, count(DISTINCT path) AS files
  FROM s WHERE (secret IS NOT NULL OR other IS NOT NULL) AND package IN (SELECT package FROM packages) AND package NOT IN (SELECT unnest({listed(REPUTABLE)})) GROUP BY package),
a AS (SELECT *, CASE WHEN secret IS NOT NULL THEN 100 ELSE 80 END + CASE WHEN hidden THEN 15 ELSE 0 END AS x FROM g),
b AS (SELECT *, CASE WHEN files > 1 THEN least(100, round(x * 1.3)) ELSE x END AS y FROM a),
named AS (SELECT package FROM hooks WHERE contains(body, 'Miasma: The Spreading Blight') AND package NOT IN (SELECT unnest({listed(REPUTABLE)})) UNION SELECT package FROM files WHERE contains(content, 'Miasma: The Spreading Blight'))
SELECT package, CAST(greatest(50, least(100, CASE WHEN paas THEN y + 15 ELSE y END)) AS INT) AS score, coalesce(secret, other) AS subtype, CASE WHEN secret IS NOT NULL THEN 'critical' ELSE 'high' END AS severity, files
FROM b WHERE package NOT IN (SELECT package FROM named) UNION ALL SELECT package, 98, 'named_signature_miasma', 'critical', 0 FROM named""",
}


def _first(column: str, checks) -> str:
    """SQL: the place in the list of the first pattern that matches."""
    return "CASE " + " ".join(f"WHEN {c if c.startswith(('(regexp_matches', '((regexp_matches')) else has(column, c)} THEN {k}" for k, c in enumerate(checks)) + " END"


def _gated(hit: str, names: list[str]) -> str:
    return "CASE " + hit + " " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"


_CI = [r"process\.env\.CI\b", r"process\.env\.(TRAVIS|CIRCLECI|GITHUB_ACTIONS|JENKINS|GITLAB_CI|CODEBUILD)", r"\bisCI\b"]
_TIME = [
    r"new Date\(\)\s*[><=!]+\s*new Date\(['\"]\d{4}", r"(?i)\bDate\.now\(\)\s*[><=!]+.*(?:eval|fetch|exec|write|crypto|env\.CI)", r"\bsetTimeout\s*\([^)]*,\s*[1-9]\d{3,}",
    r"(?i)\bDate\(\)\b.*(?:exec|eval|fetch|write|crypto)",
]
_EVADE = [
    r"(?m)\bdebugger\s*;?(\s*//|\s*$|\)|\])", r"process\.argv.*['\"]--inspect['\"]|process\.argv.*\binspect\b", r"(?i)hostname.*(?:docker|sandbox|container|vmware|vbox)",
    r"(?i)detect.*(?:sandbox|debugger|analysis|virtual)", r"(?i)e\.stack\b.*(?:sandbox|docker|container|vmware)",
]
_APIS = ["process.pid", "process.ppid", "os.hostname", "os.cpus", "process.arch"]
_SUSPICIOUS = [r"\beval\(|atob\(|btoa\(|new Function\(|child_process\b|\.exec\(|spawn\(", r"\.fetch\(|http\.request\(|https\.request\(|dns\.lookup\("]

ORACLE["atk_code_rules"] = WITH + f""", t AS (SELECT package, content AS c FROM files), x AS (SELECT package, bool_or({has('c', R.CREDENTIALS)}) AS cred, bool_or({has('c', R.PERSISTENCE)}) AS persist, bool_or({has('lower(c)', R.EXFILTRATION)}) AS exfil,
  bool_or({has('c', *_SUSPICIOUS)} OR regexp_matches(regexp_replace(c, 'process\\.env\\.NODE_ENV', '', 'g'), 'process\\.env\\.[A-Z_]{{4,}}')) AS suspicious,
  min({_first('c', _CI)}) AS ci, min({_first('c', _TIME)}) AS tm, min({_first('c', _EVADE)}) AS ev, min({_first('c', [p for _, p in R.PROPAGATION_HIGH[:1]])}) AS up,
  min({_first('c', [p for _, p in R.PROPAGATION_MEDIUM])}) AS down, {' + '.join(f"CAST(bool_or(contains(c, '{a}')) AS INT)" for a in _APIS)} AS apis,
  bool_or(contains(c, 'Error().stack')) AND bool_or({has('c', 'atob|eval|execSync|spawn|child_process')}) AS stack FROM t GROUP BY package)
SELECT package, 'ATK-003' AS id, 'high' AS severity, 'credentials' AS evidence FROM x WHERE cred UNION ALL SELECT package, 'ATK-004', 'high', 'editor settings' FROM x WHERE persist
UNION ALL SELECT package, 'ATK-005', 'critical', 'exfiltration' FROM x WHERE exfil UNION ALL SELECT package, 'ATK-009', 'high', {_gated('ci', ['ci_variable', 'ci_vendor', 'is_ci_helper'])} FROM x WHERE ci IS NOT NULL
UNION ALL SELECT package, 'ATK-009', CASE WHEN suspicious THEN 'high' ELSE 'medium' END, {_gated('tm', ['date_compare', 'clock_gate', 'long_timer', 'date_gate'])} FROM x WHERE tm IS NOT NULL
UNION ALL SELECT package, 'ATK-010', 'high', {_gated('ev', ['debugger', 'inspect_flag', 'host_name', 'evasion_word', 'stack_text'])} FROM x WHERE ev IS NOT NULL
UNION ALL SELECT package, 'ATK-010', 'medium', CAST(apis AS VARCHAR) || ' host APIs' FROM x WHERE ev IS NULL AND apis >= 3
UNION ALL SELECT package, 'ATK-010', 'medium', 'stack and execution' FROM x WHERE stack UNION ALL SELECT package, 'ATK-011', 'high', 'install_call' FROM x WHERE up IS NOT NULL
UNION ALL SELECT package, 'ATK-011', 'medium', {_gated('down', ['own_name', 'dependency_link', 'dependency_folder', 'sibling_require'])} FROM x WHERE up IS NULL AND down IS NOT NULL"""

_MINIFIED = """(length({0}) >= 100 AND ((len(string_split({0}, chr(10))) <= 3 AND length({0}) > 1000) OR (len(regexp_extract_all({0}, '[A-Za-z_$][A-Za-z0-9_$]*')) >= 10
    AND length(array_to_string(regexp_extract_all({0}, '[A-Za-z_$][A-Za-z0-9_$]*'), '')) < 3 * len(regexp_extract_all({0}, '[A-Za-z_$][A-Za-z0-9_$]*')))))"""
ORACLE["obfuscation_score"] = WITH + f""", x AS (SELECT id, round({_ENTROPY.format('content')}, 2) AS e, {_MINIFIED.format('content')} AS m, length(content) > 100000 AS large,
  list_filter([{', '.join(f"CASE WHEN {has('content', p)} THEN '{n}' END" for n, p in D.CODE_PATTERNS.items())}], lambda p: p IS NOT NULL) AS p FROM files WHERE length(content) >= 100),
y AS (SELECT id, array_to_string(p, ',') AS patterns, CASE WHEN e > 5.3 THEN 35 ELSE 0 END + CASE WHEN e > 5.8 THEN 15 ELSE 0 END + CASE WHEN len(p) >= 3 THEN 30 WHEN len(p) >= 1 THEN 20 ELSE 0 END + CASE WHEN m THEN 10 ELSE 0 END
  + CASE WHEN large THEN 15 ELSE 0 END + CASE WHEN list_contains(p, 'XOR_CIPHER') AND len(p) >= 2 THEN 10 ELSE 0 END + CASE WHEN list_contains(p, 'EVAL_USAGE') AND e > 5.0 THEN 15 ELSE 0 END AS s FROM x)
SELECT id, least(s, 100) AS score, patterns FROM y WHERE s >= 50"""


def _build_sql() -> str:
    parts = []
    for where, det in K.BUILD_FILES.items():
        for signal, (weight, patterns) in det.signals.items():
            parts.append(f"SELECT package, '{signal}' AS signal, sum({count('content', *patterns)}) AS n, {weight} AS w, '{det.flag}|{where[-6:]}' AS part FROM files WHERE {has('path', where)} GROUP BY package")
    return WITH + ", s AS (" + " UNION ALL ".join(sql_ for sql_ in parts) + """ UNION ALL SELECT DISTINCT package, 'gyp_present', 1, 20, 'gyp' FROM files WHERE regexp_matches(path, '\\.gypi?$')),
g AS (SELECT package, least(100, sum(n * w)) AS score, array_to_string(list_sort(list(signal)), ',') AS signals FROM s WHERE n > 0 GROUP BY package)
SELECT package, CAST(score AS INT) AS score, signals, CASE WHEN score >= 99 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS severity FROM g"""


ORACLE["build_config"] = _build_sql().replace("'99|(^|/)", "'99|")
_KINDS = [
    ("hex_payload", "medium", P.RUNS, f"({has('c', P.RUNS)} AND {has('c', P.HEX_DECODE)})"), ("base64_payload", "medium", P.RUNS, f"({has('c', P.RUNS)} AND {has('c', P.B64_DECODE, P.B64_OTHER)})"),
    ("hidden_network", "medium", r"atob\(|Buffer\.from", f"({has('c', r'atob\(|Buffer\.from')} AND {has('c', P.NET_WORDS)} AND {has('c', P.NET_HIDDEN)})"),
    ("char_codes", "medium", r"String\.fromCharCode\(", f"({has('c', P.RUNS)} AND {has('c', P.CHAR_CODES)})"), *[(n, "high", p, has("c", p)) for n, p in P.SHELL_CODE],
]
_LINE = "len(regexp_extract_all(split_part(regexp_replace(c, {0}, chr(7)), chr(7), 1), chr(10))) + 1"
ORACLE["hidden_payload"] = WITH + f""", k AS (SELECT package, path, content AS c, {_first('c', [h for *_, h in _KINDS])} AS k FROM files),
f AS (SELECT package, path, {_gated('k', [n for n, *_ in _KINDS])} AS kind, CASE WHEN k < 4 THEN 'medium' ELSE 'high' END AS severity, CASE k {' '.join(f'WHEN {i} THEN {_LINE.format(sql(p))}' for i, (_, _, p, _) in enumerate(_KINDS))} END AS line,
  CASE WHEN {has('c', "Buffer\\.from\\(['\"][0-9a-fA-F]+['\"],\\s*['\"]hex['\"]\\)")} THEN 'hex' WHEN {has('c', r'atob\(', r'btoa\(', r'Buffer\.from\([A-Za-z0-9+/=]{10,}')} THEN 'base64' WHEN contains(c, 'String.fromCharCode(') THEN 'charcode' ELSE 'unknown' END AS encoding_type,
  nullif(regexp_extract(c, 'atob\\([''"]([A-Za-z0-9+/=]{{10,}})[''"]\\)', 1), '') AS b, nullif(regexp_extract(c, 'Buffer\\.from\\([''"]((?:[0-9a-fA-F]{{2}})+)[''"],\\s*[''"]hex[''"]\\)', 1), '') AS x,
  nullif(regexp_extract(c, 'https?://([^/''"\\s]+)', 1), '') AS url_domain FROM k WHERE k IS NOT NULL),
one AS (SELECT package, path, min_by(f, coalesce(kind, '')) AS f FROM f GROUP BY package, path),
top AS (SELECT o.* FROM one o WHERE path = (SELECT min(path) FROM one WHERE package = o.package)),
named AS (SELECT t.package, bool_or(contains(body, t.path) OR contains(body, regexp_extract(t.path, '([^/]+)$', 1)) OR (regexp_extract(body, '[^\\s''"]+\\.js$') <> '' AND ends_with(t.path, regexp_extract(body, '[^\\s''"]+\\.js$')))) AS hit
  FROM top t JOIN hooks h ON h.package = t.package WHERE hook IN ('install', 'postinstall', 'preinstall', 'prepare', 'prepack', 'postpack') GROUP BY t.package)
SELECT 'ATK-002' AS atk_id, t.package, t.path, f.kind AS kind, f.severity AS severity, f.line AS line, f.encoding_type AS encoding_type, coalesce(decode(try(from_base64(f.b))), decode(try(unhex(f.x)))) AS decoded_preview, f.url_domain AS url_domain,
  coalesce(regexp_matches(f.url_domain, '(^|\\.)(registry\\.npmjs\\.org|cdn\\.jsdelivr\\.net|unpkg\\.com|cdn\\.skypack\\.dev|esm\\.sh|deno\\.land|raw\\.githubusercontent\\.com|github\\.com|npmjs\\.com|nodejs\\.org|v8\\.dev|typescriptlang\\.org)$'), false) AS is_known_safe_domain,
  regexp_matches(t.path, '/dist/|/build/|/bundle|/min/|\\.min\\.js$|\\.bundled?\\.js$') AS is_dist_build, regexp_matches(t.path, '/test/|/tests/|/__tests__/|/spec/|\\.test\\.js$|\\.spec\\.js$|fixtures?') AS is_test_fixture,
  coalesce(n.hit, false) OR regexp_replace(regexp_extract(t.path, '([^/]+)$', 1), '\\.js$', '') IN ('install', 'postinstall', 'preinstall', 'prepare', 'prepack', 'postpack', 'setup', 'install-helper') AS is_lifecycle_hook
FROM top t LEFT JOIN named n ON n.package = t.package"""

_ROLL = "SELECT package, version, array_to_string(list_sort(list_distinct(list(rule))), ',') AS rules, {0} AS severity FROM h GROUP BY package, version"
_BASE = "regexp_extract(path, '([^/]+)$', 1)"
ORACLE["campaign_trapdoor"] = WITH + f""", hit AS (
  SELECT package, 'D1' AS rule FROM files WHERE ({_BASE} IN ('.cursorrules', 'CLAUDE.md', 'README.md', 'package.json') OR regexp_matches(path, '\\.(md|sh|json)$')) AND contains(content, 'P-2024-001')
  UNION ALL SELECT package, 'D2' FROM files WHERE {_BASE} = 'trap-core.js' OR strlen(content) = 48485 UNION ALL SELECT package, 'D3' FROM packages WHERE publisher = 'asdxzxc'
  UNION ALL SELECT package, 'D4' FROM (SELECT package, content FROM files WHERE regexp_matches(path, '\\.(js|mjs|cjs)$') UNION ALL SELECT package, body FROM hooks WHERE regexp_matches(hook, 'preinstall|install|postinstall|prepare'))
    WHERE regexp_matches(content, '(?i)ddjidd564\\.github\\.io|gist\\.github\\.com') AND regexp_matches(content, '(?i)\\.aws/|id_rsa|\\.env|keystore|credentials|\\.npmrc|\\.ssh/')
  UNION ALL SELECT package, 'D5' FROM files WHERE lower({_BASE}) IN ('.cursorrules', 'claude.md') AND regexp_matches(content, '[​-‍﻿]')
  UNION ALL SELECT package, 'D7' FROM (SELECT package, content FROM files WHERE regexp_matches(path, '\\.(js|mjs|cjs)$') UNION ALL SELECT package, body FROM hooks WHERE regexp_matches(hook, 'preinstall|install|postinstall|prepare'))
    WHERE regexp_matches(content, '(?i)fernet') AND regexp_matches(content, '(?i)\\b(create)?ECDH\\b')
  UNION ALL SELECT package, 'D8' FROM files WHERE regexp_matches(path, '(?i)(package-lock\\.json|yarn\\.lock|pnpm-lock\\.ya?ml|Cargo\\.(lock|toml))|\\.node$|vendor|native') AND contains(content, 'cargo-build-helper-2026')
  UNION ALL SELECT package, 'D9' FROM (SELECT package, content FROM files WHERE regexp_matches(path, '\\.(js|mjs|cjs)$') UNION ALL SELECT package, body FROM hooks WHERE regexp_matches(hook, 'preinstall|install|postinstall|prepare'))
    WHERE regexp_matches(content, '(?i)sts\\.amazonaws\\.com|api\\.github\\.com/user')
  UNION ALL SELECT package, 'D6' FROM packages WHERE regexp_matches(package, '(?i)solidity|defi|solana|sui\\b|move-lang|^eth-|prompt-engineering|token-usage|dev-env-bootstrap')
    AND TIMESTAMP '2024-02-01' - first_published < INTERVAL 30 DAY AND versions <= 2),
h AS (SELECT p.package, p.version, rule FROM packages p JOIN hit ON hit.package = p.package)
""" + _ROLL.format("CASE WHEN bool_or(rule IN ('D1', 'D2', 'D3', 'D4', 'D9')) THEN 'critical' WHEN bool_or(rule IN ('D5', 'D7', 'D8')) THEN 'high' ELSE 'medium' END")
ORACLE["campaign_poisoned_client"] = WITH + f""", act AS (SELECT DISTINCT package, body FROM hooks WHERE hook IN ('postinstall', 'install', 'preinstall')),
texts AS (SELECT package, body AS c FROM act UNION ALL SELECT package, content FROM files WHERE package IN (SELECT package FROM act)),
signed AS (SELECT package, bool_or({has('c', *C.HOOK_CODE)}) AS code, {', '.join(f"bool_or({has('c', p)}) AS {n}" for n, p in C.PLANTED.items())} FROM texts GROUP BY package),
seen AS (SELECT package FROM signed WHERE code AND drops AND (calls OR powershell OR loads OR injects OR launchd OR services OR temp)),
h AS (SELECT package, version, 'D2' AS rule FROM packages WHERE dependency = 'plain-crypto-js' UNION ALL SELECT package, version, 'D3' FROM packages WHERE package IN (SELECT package FROM seen))
""" + _ROLL.format("'critical'")
ORACLE["campaign_copied_names"] = WITH + f""", hit AS (
  SELECT package, version, 'D1S' AS rule FROM packages WHERE publisher = 'vpmdhaj' OR package LIKE 'vpmdhaj-%'
  UNION ALL SELECT package, version, 'D1' FROM packages WHERE regexp_matches(lower(package), 'opensearch|env-config|envconfig')
  UNION ALL SELECT package, version, 'D2' FROM packages WHERE hook = 'preinstall'
  UNION ALL SELECT p.package, p.version, 'D3' FROM packages p WHERE p.package IN (SELECT package FROM files WHERE {has('content', *C.CLOUD_SECRETS)})),
h AS (SELECT * FROM hit WHERE rule = 'D1S' OR package NOT IN (SELECT package FROM hit WHERE rule = 'D1S'))
""" + _ROLL.format("'critical'")


def _rolled(facts: str, weights: dict[str, int], anchors: list[str], name: str) -> str:
    """SQL: signals once per package, nothing without an anchor, the clamped sum from 55 on."""
    have = [w for w in weights if f" AS {w}" in facts]
    total = " + ".join(f"CAST({w} AS INT) * {weights[w]}" for w in have)
    fired = ", ".join(f"CASE WHEN {w} THEN '{w}' END" for w in have)
    return f"""{facts},
g AS (SELECT package, {', '.join(f'coalesce(bool_or({w}), false) AS {w}' for w in have)} FROM facts GROUP BY package),
r AS (SELECT package, least(100, {total}) AS score, concat_ws(',', {fired}) AS signals FROM g WHERE {' OR '.join(a for a in anchors if a in have)})
SELECT package, '{name}' AS detector, score, signals, true AS approx, CASE WHEN score >= 80 THEN 'critical' ELSE 'high' END AS severity FROM r WHERE score >= 55"""


from tarnwatch.operators import code_facts as X  # noqa: E402

_TXT, _FINGER = X._DNS_TXT, r"process\.(platform|arch)\b|\bos\.(platform|arch|type|release)\s*\("
_ARRAYS = f"""len(list_filter(regexp_extract_all(content, {sql(r"\[\s*(?:['\"][^'\"\n]*['\"]\s*,\s*){7,}['\"][^'\"\n]*['\"]\s*,?\s*\]")}, 0), lambda a: len(list_filter(regexp_extract_all(a, {sql(r"['\"]([^'\"\n]*)['\"]")}, 1),
  lambda s: regexp_matches(s, '^(?:[0-9a-fA-F]{{2}}){{3,}}$') OR (regexp_matches(s, '^[A-Za-z0-9+/]{{16,}}={{0,2}}$') AND list_aggregate(string_split(s, ''), 'entropy') >= 4.5))) >= 0.8 * len(regexp_extract_all(a, {sql(r"['\"]([^'\"\n]*)['\"]")}, 1)))) > 0"""
_DENSE = f"""len(list_filter(regexp_extract_all(content, {sql(r"['\"`]([^'\"`\n]{64,})['\"`]")}, 1), lambda s: list_aggregate(string_split(s, ''), 'entropy') > 5.0)) >= 3"""
ORACLE["dropper"] = _rolled(WITH + f""", code AS (SELECT package, content FROM files WHERE regexp_matches(path, '\\.(js|mjs|cjs)$') AND {has('content', X._MARKER)}),
facts AS (SELECT package, {has('content', _TXT)} AND {has('content', X._DECODER)} AND {has('content', X._SINK)} AS dns_payload_assembly, {_ARRAYS} AS encoded_string_array, {has('content', _TXT)} AS dns_txt_oob,
  {_ARRAYS} AND {has('content', X._DECODER)} AS string_array_decoder, {has('content', _FINGER)} AND {has('content', X._NETWORK, _TXT)} AS fingerprint_network_coupling,
  NOT {_MINIFIED.format('content')} AND {_DENSE} AS high_entropy_literals, {has('content', P.PAAS)} AS paas_stage_resolution,
  {has('content', _FINGER)} AS env_fingerprint FROM code)""", X.DROPPER, X.DROPPER_ANCHORS, "D28-AI-SLOP-DROPPER")
_GET = " OR ".join(has("{0}", p) for p in X.RUNTIME_DOWNLOADS)
_RUN = r"\bBun\.(spawn|spawnSync|\$)\s*[(`]|\bDeno\.(run|Command)\b|\bstd\.popen\s*\(|\bos\.exec\s*\("
_CONNECT = r"\bBun\.(connect|fetch)\s*\(|\bDeno\.(connect|connectTls)\s*\("
ORACLE["runtime_evasion"] = _rolled(WITH + f""", act AS (SELECT package, body FROM hooks WHERE regexp_matches(hook, '^(pre|post)?install$')),
named AS (SELECT DISTINCT package, unnest(regexp_extract_all(body, '([\\w.-]+\\.(?:js|mjs|cjs|ts|sh))', 1)) AS base FROM act),
f AS (SELECT files.*, EXISTS (SELECT 1 FROM named n WHERE n.package = files.package AND n.base = regexp_extract(path, '([^/]+)$', 1)) AS install,
  CASE WHEN package IN (SELECT package FROM packages) THEN path = 'f1/index.js' ELSE path = 'index.js' END AS entry FROM files),
facts AS (SELECT package, ({_GET.replace('{0}', 'content')}) AND install AS runtime_download_install_time, ({_GET.replace('{0}', 'content')}) AS runtime_download, {has('content', r'bun:ffi|\bDeno\.dlopen\s*\(')} AS alt_runtime_ffi,
  {has('content', _RUN)} AND (install OR entry) AS alt_runtime_exec_entry, {has('content', _RUN)} AS alt_runtime_exec, {has('content', _CONNECT)} AND (install OR entry) AS alt_runtime_network_entry, {has('content', _CONNECT)} AS alt_runtime_network,
  {has('content', r'\b(Bun\.env|Deno\.env)\b.{0,60}(TOKEN|SECRET|KEY|PASSWORD)', r'\b(Bun\.file|Deno\.readTextFile(Sync)?)\s*\([^)]{0,20}(\.npmrc|\.ssh|\.aws)')} AS alt_runtime_credential_access,
  {has('content', r'\b(Bun\.env|Deno\.env)\b')} AS alt_runtime_env_read, {has('content', r'\b(Bun|Deno)\.(serve|listen)\s*\(')} AS alt_runtime_listen, {has('content', r'\bBun\.file\s*\(|\bDeno\.read\w*\s*\(')} AS alt_runtime_fs_read,
  {has('content', r'typeof\s+(Bun|Deno)\b')} AS runtime_fingerprint, false AS alt_runtime_hook_interpreter FROM f WHERE ({_GET.replace('{0}', 'content')}) OR {has('content', r'\b(Bun|Deno)\b|\bstd\.|\bos\.exec|bun:ffi')}
  UNION ALL SELECT package, ({_GET.replace('{0}', 'body')}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {has('body', r'^\s*(bun|deno|qjs)\s')} FROM act)""", X.RUNTIME, X.RUNTIME_ANCHORS, "D29-RUNTIME-EVASION")
_BAND = "CASE " + " ".join(f"WHEN {has('target', p)} THEN '{b}'" for b, p in X.SURFACES) + " END"
ORACLE["workspace_persistence"] = WITH + f""", code AS (SELECT package, content FROM files WHERE regexp_matches(path, '\\.(js|mjs|cjs)$')),
hits AS (SELECT package, unnest(regexp_extract_all(content, {sql(r"\bwriteFile(?:Sync)?\s*\(\s*['\"`]([^'\"`]+)['\"`]")}, 1)) AS target, 'static_surface_write' AS kind FROM code
  UNION ALL SELECT package, array_to_string(regexp_extract_all(call, {sql(r"['\"`]([^'\"`]+)['\"`]")}, 1), '/'), 'dynamic_surface_write' FROM (SELECT package, unnest(regexp_extract_all(content, {sql(r"\bwriteFile(?:Sync)?\s*\(\s*(?:path\.(?:join|resolve)\s*\(|\[)([^)\]]*)[)\]]")}, 1)) AS call FROM code)
  UNION ALL SELECT package, target, CASE WHEN regexp_matches(target, '(?i)\\.github/workflows/') AND regexp_matches(content, 'pull_request_target|workflow_run') THEN 'shipped_workflow_privileged_trigger' ELSE 'shipped_exec_config' END
    FROM (SELECT package, path AS target, content FROM files) WHERE {_BAND} = 'exec' AND regexp_matches(content, '"command"\\s*:|"hooks"\\s*:|folderOpen|postCreateCommand|run:')),
o AS (SELECT DISTINCT package, kind, {_BAND} AS band FROM hits),
g AS (SELECT package, CAST(least(100, sum(CASE kind {' '.join(f"WHEN '{k}' THEN {w}" for k, w in X.WRITE_WEIGHT.items())} END + CASE band WHEN 'exec' THEN 30 WHEN 'agent_read' THEN 15 ELSE 0 END)) AS INT) AS score,
  array_to_string(list_sort(list(kind || ':' || band)), ',') AS signals FROM o WHERE band IS NOT NULL GROUP BY package)
SELECT package, score, signals, CASE WHEN score >= 80 THEN 'critical' WHEN score >= 45 THEN 'high' ELSE 'medium' END AS severity, true AS approx FROM g"""

ORACLE["campaign_scrambled_worm"] = WITH + f""", seen AS (SELECT package, bool_or({has('content', C.LOCALE)}) AND bool_or({has('content', C.LOCALE_SWITCH)}) AS d3, bool_or(contains(content, '{C.DROP_WORD}'))
    OR (bool_or({has('content', C.HUB_API)}) AND (bool_or({has('content', C.HUB_TOKEN)}) OR bool_or({has('content', C.COMMIT_LOOP)}))) AS d4 FROM files GROUP BY package),
hit AS (SELECT package, 'D1' AS rule FROM files WHERE {has('content', C.SCRAMBLE)} UNION ALL SELECT package, 'D2' FROM files WHERE {has('content', *C.PERSISTS)}
  UNION ALL SELECT package, 'D2' FROM hooks WHERE hook IN ('preinstall', 'install', 'postinstall', 'preuninstall', 'postuninstall') AND {has('body', *C.PERSISTS)}
  UNION ALL SELECT package, 'D3' FROM seen WHERE d3 UNION ALL SELECT package, 'D4' FROM seen WHERE d4),
h AS (SELECT p.package, p.version, rule FROM packages p JOIN hit ON hit.package = p.package WHERE rule = 'D1' OR p.package NOT IN (SELECT package FROM hit WHERE rule = 'D1'))
""" + _ROLL.format("CASE WHEN bool_or(rule <> 'D3') THEN 'critical' ELSE 'high' END")
ORACLE["campaign_hijacked_module"] = WITH + f""", pk AS (SELECT CASE WHEN id = 7 THEN 'node-ipc' ELSE package END AS package, CASE WHEN id = 7 THEN '9.1.6' ELSE version END AS version, hook, body FROM packages),
hk AS (SELECT package, hook, body FROM pk UNION ALL SELECT package, 'test', 'node t.js' FROM pk WHERE hook <> 'test'),
js AS (SELECT package, content AS c FROM files WHERE regexp_matches(path, '\\.(js|mjs|cjs)$')),
act AS (SELECT package, body AS c FROM hk WHERE regexp_matches(hook, 'preinstall|install|postinstall|prepare')),
hit AS (SELECT 'node-ipc' AS package, 'D1' AS rule UNION ALL SELECT 'node-ipc', 'D10'
  UNION ALL SELECT package, 'D5' FROM (SELECT * FROM js UNION ALL SELECT * FROM act) WHERE {has('c', C.RESOLVER)} AND regexp_extract(c, {sql(C.RESOLVER_ADDRESS)}, 1) NOT IN ('', '1.1.1.1', '8.8.8.8', '8.8.4.4', '9.9.9.9')
  UNION ALL SELECT package, 'D6' FROM (SELECT package, content AS c FROM files UNION ALL SELECT package, body FROM hk) WHERE {has('c', C.HIJACK_HOSTS)}
  UNION ALL SELECT package, 'D7' FROM (SELECT * FROM js UNION ALL SELECT * FROM act) WHERE {has('c', C.HIJACK_ZONE)}
  UNION ALL SELECT package, 'D8' FROM (SELECT * FROM js UNION ALL SELECT package, body FROM hk) WHERE {has('c', r'\bsetImmediate\s*\(')}
  UNION ALL SELECT package, 'D9' FROM files WHERE path LIKE '%~/nt-1a/x.tar.gz' UNION ALL SELECT package, 'D11' FROM files WHERE path LIKE '%package-lock.json' AND contains(content, 'node-ipc') AND contains(content, '"9.1.6"')
  UNION ALL SELECT package, 'D2' FROM files WHERE sha256(content) IN (SELECT sha256(content) FROM files WHERE id % 40 = 0)),
h AS (SELECT p.package, p.version, rule FROM pk p JOIN hit ON hit.package = p.package)
""" + _ROLL.format("CASE WHEN bool_or(rule <> 'D8') THEN 'critical' ELSE 'info' END")
