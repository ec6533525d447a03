"""Packages against where they say they come from: attestations by time, and source trees by capability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch.functions import severity as S
from tarnwatch.operators.iocs import sized
from tarnwatch.operators.windows import HOUR, anchored_burst, micros

# The shortest gap that a build takes, and the builders that are known.
BUILD_MICROS = 60_000_000
BUILDERS = ["https://github.com/", "https://gitlab.com/", "https://circleci.com/"]


def attestation_anomalies(versions: DataFrame, attestations: DataFrame) -> DataFrame:
    """versions (package, version, published_at), attestations (package, version, attested_at, builder) to the anomalies of
    each attested version: package, version, kind, gap_ms.

    sub_minute: an attestation less than a minute after its publication; unknown_builder; first_attested: neither of the
    two versions before it has one. Each attestation meets its version by an equi-join, and versions before it by a window;
    an attestation before its publication is none of the first kind."""
    a = attestations.withColumn("a", micros("attested_at")).select("package", "version", "a", "builder")
    v = versions.select("package", "version", micros("published_at").alias("p")).groupBy("package", "version").agg(F.min("p").alias("p"))
    some = a.groupBy("package", "version").agg(F.count("*").alias("n"))
    order = Window.partitionBy("package").orderBy("p", "version")
    v = v.join(some, ["package", "version"], "left").withColumns({"b1": F.lag("version").over(order), "n1": F.lag("n").over(order), "n2": F.lag("n", 2).over(order)})
    first = v.where("n IS NOT NULL AND b1 IS NOT NULL AND n1 IS NULL AND n2 IS NULL").select("package", "version", F.lit("first_attested").alias("kind"), F.lit(None).cast("long").alias("gap_ms"))
    met = a.join(v.select("package", "version", "p"), ["package", "version"])
    gap = F.col("a") - F.col("p")
    quick = met.where((gap >= 0) & (gap < BUILD_MICROS)).select("package", "version", F.lit("sub_minute").alias("kind"), F.expr("(a - p) div 1000").alias("gap_ms"))
    known = reduce(lambda x, y: x | y, [F.col("builder").startswith(b) for b in BUILDERS])
    odd = met.where(F.col("builder").isNotNull() & ~known).select("package", "version", F.lit("unknown_builder").alias("kind"), F.lit(None).cast("long").alias("gap_ms"))
    return first.unionByName(quick).unionByName(odd).distinct()


# Secrets that install scripts of the campaign read, and the scopes of its waves.
TOKEN_EXFIL = [
    r"(?i)NPM_TOKEN|NODE_AUTH_TOKEN|GH_TOKEN|GITHUB_TOKEN", r"~/(\.npmrc|\.gitconfig|\.aws/credentials)", r"/run/secrets/", r"\$GITHUB_ENV",
    r"Buffer\.from\s*\([^)]*\)\s*\.\s*toString\s*\(\s*['\"]base64['\"]\s*\)", r"\batob\s*\(", r"\bbtoa\s*\(",
]
INSTALL_SCRIPTS = ["preinstall", "install", "postinstall", "prepare"]


def worm_campaign(packages: DataFrame, versions: DataFrame, attestations: DataFrame, siblings: DataFrame, handovers: DataFrame, listed: DataFrame, within: int = HOUR, least: int = 3) -> DataFrame:
    """The worm's rules, gated and rolled up: package, version, rules, severity, wave.

    D1 a burst of versions; only where it fired count D2 siblings (package) and D3 attestation anomalies of the version;
    D4 handovers (package); D5 listed (package, version, wave) indicators; D6 install scripts that read tokens; D7 build-tool
    dependencies. Critical by D3, D5 or D7, else high. packages: package, version, scripts, dependencies."""
    key = ["package", "version"]
    own = packages.select(*key).distinct()
    mark = lambda df, on, name: df.select(*on).distinct().withColumn(name, F.lit(1))
    burst = anchored_burst(versions, "package", "published_at", within, least).select("package")
    odd = attestation_anomalies(versions, attestations).join(burst, "package", "left_semi")
    near = siblings.select("package").join(burst, "package", "left_semi")
    scripts = packages.select(*key, F.explode(F.map_entries("scripts")).alias("s")).where(F.col("s.key").isin(INSTALL_SCRIPTS))
    exfil = scripts.where(reduce(lambda a, b: a | b, [F.col("s.value").rlike(p) for p in TOKEN_EXFIL]))
    tools = packages.where(F.exists(F.map_keys(F.coalesce("dependencies", F.create_map().cast("map<string,string>"))), lambda d: d.startswith("@nx/") | d.startswith("nrwl/")))
    waves = listed.groupBy(*key).agg(F.when(F.countDistinct("wave") == 1, F.max("wave")).alias("listed_wave"), F.lit(1).alias("D5"))
    parts = [(burst, ["package"], "D1"), (near, ["package"], "D2"), (odd, key, "D3"), (handovers, ["package"], "D4"), (exfil, key, "D6"), (tools, key, "D7")]
    found = reduce(lambda df, part: df.join(mark(*part), part[1], "left"), parts, own).join(waves, key, "left")
    rules = F.array_compact(F.array(*[F.when(F.col(f"D{k}").isNotNull(), F.lit(f"D{k}")) for k in range(1, 8)]))
    wave = (
        F.when(F.col("package").startswith("@tanstack"), "wave1").when(F.col("package").startswith("@antv"), "wave2").when(F.col("D7").isNotNull(), "wave3")
        .when(F.col("listed_wave").isNotNull(), F.concat(F.lit("wave"), F.col("listed_wave").cast("string"))).otherwise("unknown")
    )
    worst = F.when(F.coalesce("D3", "D5", "D7").isNotNull(), "critical").otherwise("high")
    return found.withColumn("rules", rules).where(F.size("rules") > 0).select(*key, F.array_join("rules", ",").alias("rules"), worst.alias("severity"), wave.alias("wave"))


# Calls that give a script a capability, which scripts are compared, and which are built rather than written.
CAPABILITIES = {
    "exec": r"\b(?:exec|execSync|execFile|execFileSync|spawn|spawnSync|fork)\s*\(|\bBun\.spawn(?:Sync)?\s*\(|\bDeno\.(?:run|Command)\b", "network": r"\b(?:fetch|axios|got)\s*\(|\b(?:https?|net|tls)\.(?:get|request|connect)\s*\(",
    "dynamic_code": r"\beval\s*\(|\bnew\s+Function\s*\(|\brunInNewContext\s*\(", "ffi": r"\bdlopen\s*\(|\bbun:ffi\b",
}
SCRIPT = r"(?i)\.(?:js|mjs|cjs|ts|mts|cts|sh|bash|ps1)$"
BUILT = r"(?i)(^|/)(dist|build|out|es|esm|cjs|umd|types|coverage|node_modules)/|(?:\.min\.js|\.map|\.d\.ts|\.tsbuildinfo)$"
NOT_COMPARED = r"(?i)(^|/)(package\.json|package-lock\.json|npm-shrinkwrap\.json|readme(\.md)?|license(\.md)?|licence|changelog\.md|\.npmignore|\.gitignore)$"
RUNS_FILE = r"(?:^|[\s;&|])(?:node|nodejs|sh|bash|bun|deno|qjs)\s+(?:\./)?([^\s;&|'\"]+)"


def capability_desync(packages: DataFrame, tarball: DataFrame, source: DataFrame) -> DataFrame:
    """Packages whose files do not follow from their source tree: package, score, severity, status, kinds, capabilities.

    packages: package, scripts, bin (paths); tarball and source: package, path, content. A script that differs counts if
    it gains a capability (95), or if hooks or bin run it (75); one that is absent from the source counts if it has one or
    is run (95); built files are left out. Without any source file a package is unverifiable (15), never clean."""
    digest = F.sha2(F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), r"(?m)[ \t]+$", ""), 256)
    can = F.array_compact(F.array(*[F.when(F.col("content").rlike(p), F.lit(n)) for n, p in CAPABILITIES.items()]))
    hooks = packages.select("package", F.explode(F.map_entries("scripts")).alias("s")).where(F.col("s.key").isin([*INSTALL_SCRIPTS, "prepublish"]))
    runs = hooks.select("package", F.explode(F.regexp_extract_all("s.value", F.lit(RUNS_FILE), F.lit(1))).alias("path"))
    runs = runs.unionByName(packages.select("package", F.explode("bin").alias("path"))).select("package", F.regexp_replace("path", r"^\./", "").alias("path")).distinct().withColumn("runs", F.lit(True))
    own = tarball.select("package", "path", F.coalesce("content", F.lit("")).alias("content")).select("package", "path", digest.alias("d"), can.alias("can"))
    own = own.join(runs, ["package", "path"], "left").where((F.col("runs").isNotNull() | F.col("path").rlike(SCRIPT)) & ~F.col("path").rlike(BUILT) & ~F.col("path").rlike(NOT_COMPARED))
    theirs = source.select("package", "path", F.coalesce("content", F.lit("")).alias("content")).select("package", "path", digest.alias("sd"), can.alias("could"))
    trees = source.select("package").distinct().withColumn("tree", F.lit(True))
    j = own.join(theirs, ["package", "path"], "left")
    none = F.array().cast("array<string>")
    gained = F.when(F.col("sd").isNull(), F.col("can")).otherwise(F.array_except("can", F.coalesce("could", none)))
    absent = F.col("sd").isNull() & (F.col("runs").isNotNull() | (F.size("can") > 0))
    kind = F.when(absent, "absent_from_source").when(F.col("sd").isNull(), None).when(F.col("sd") == F.col("d"), None).when(F.size(gained) > 0, "sensitive_nodes_added").when(F.col("runs").isNotNull(), "executable_modified")
    hits = j.withColumns({"kind": kind, "gained": gained}).where("kind IS NOT NULL").groupBy("package").agg(
        F.max(F.col("kind") != "executable_modified").alias("critical"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("gained")))).alias("capabilities"))
    all_ = packages.select("package").distinct().join(tarball.select("package").distinct(), "package", "left_semi").join(trees, "package", "left").join(hits, "package", "left")
    status = F.when(F.col("tree").isNull(), "unverifiable").when(F.col("kinds").isNotNull(), "desync")
    score = F.when(F.col("tree").isNull(), 15).when(F.col("critical"), 95).otherwise(75)
    label = S.ladder(score, [(95, "critical"), (75, "high")], "low")
    text = lambda c: F.when(F.col("tree").isNull(), "").otherwise(F.array_join(c, ","))
    return all_.withColumn("status", status).where("status IS NOT NULL").select("package", score.alias("score"), label.alias("severity"), "status", text("kinds").alias("kinds"), text("capabilities").alias("capabilities"))


# From which score on a detector's findings have which severity.
LADDERS = {
    "TIER1-BINARY-EMBED": [(0, "medium"), (70, "high"), (90, "critical")], "TIER1-CLOUD-IMDS": [(0, "medium"), (80, "high")], "TIER1-ENCRYPTED-C2": [(0, "medium"), (60, "high"), (80, "critical")],
    "TIER1-MAINTAINER-COMPROMISE": [(0, "medium"), (60, "high"), (80, "critical")], "TIER1-METADATA-SPOOF": [(0, "medium"), (70, "high")],
    "TIER1-MULTISTAGE-POSTINSTALL": [(0, "low"), (60, "medium"), (80, "high"), (95, "critical")], "TIER1-OBFUSCATION-HEURISTICS": [(0, "low"), (50, "medium"), (70, "high"), (90, "critical")],
    "TIER1-SELF-PROPAGATION": [(0, "low"), (60, "medium"), (80, "high")], "TIER1-TRANSITIVE-DEPS": [(0, "low"), (60, "medium"), (80, "high")], "TIER1-TYPOSQUAT": [(0, "low"), (60, "medium"), (80, "high")],
    "TIER1-VERSION-ANOMALY": [(0, "low"), (50, "medium"), (70, "high"), (90, "critical")], "D14-BUILD-CONFIG-ABUSE": [(0, "low"), (30, "medium"), (50, "high"), (70, "critical")],
    "D28-AI-SLOP-DROPPER": [(0, "medium"), (55, "high"), (80, "critical")], "D29-RUNTIME-EVASION": [(0, "medium"), (55, "high"), (80, "critical")], "D30-WORKSPACE-PERSISTENCE": [(0, "medium"), (45, "high"), (80, "critical")],
    "D31-TARBALL-GIT-DESYNC": [(0, "low"), (75, "high"), (95, "critical")],
}


def ladders(spark) -> DataFrame:
    """severity_ladder(detector, min_score, severity)."""
    return spark.createDataFrame([(d, m, s) for d, steps in LADDERS.items() for m, s in steps], "detector string, min_score int, severity string")


def with_severity(findings: DataFrame, ladder: DataFrame, score: str = "score") -> DataFrame:
    """Findings (detector, score) with the severity of the highest rung not above the score; null for a detector without a
    ladder, a score below its lowest rung, or none. A detector's rungs travel as one array, so that the range join keeps
    one row a finding."""
    rungs = ladder.where("detector IS NOT NULL").groupBy("detector").agg(F.array_sort(F.collect_list(F.struct("min_score", "severity"))).alias("rungs"))
    reach = F.filter("rungs", lambda r: r["min_score"] <= F.col(score))
    return findings.join(sized(rungs, 10_000), "detector", "left").withColumn("severity", F.try_element_at(reach, F.lit(-1))["severity"]).drop("rungs")


# How a hook hands over to a file, how files name others, and what the content of one weighs.
HANDS_OVER = r"^\s*(?:node|sh|bash)\s+([^\s;&|]+)\s*$"
NAMES_FILES = [r"\brequire\s*\(\s*['\"]([./][^'\"]*)['\"]\s*\)", r"(?:spawn|exec|execSync)\s*\(\s*['\"]node['\"]\s*,\s*\[\s*['\"]([^'\"]+)['\"]", r"(?:exec|execSync|spawn)\s*\(\s*['\"]node\s+([^'\"]+)['\"]"]
EVALUATES = r"\beval\s*\(|\bFunction\s*\(|\(0,\s*eval\)\s*\("
CONNECTS = r"(?i:\b(?:curl|wget|powershell)\b)|\b(?:exec|execSync|spawn|spawnSync|fork)\s*\(|\b(?:https?\.request|fetch|axios|got|superagent)\s*\("
ADDRESSES = r"(?i)https?://[^'\"\s)\]]+|\b(?:\d{1,3}\.){3}\d{1,3}\b"
ENV_SECRETS = r"process\.env\.(?:AWS_[A-Z_]+|NPM_TOKEN|NPM_AUTH_TOKEN|GIT_TOKEN|SSH_KEY)"
READS = r"\bfs\.(?:readFile|readFileSync|readdir|readdirSync)\s*\("
IDENTITIES = r"\.gitconfig|\.ssh/[a-zA-Z_]+\.pub|\.aws/config|\.config/git/config|\.config/gcloud/properties|resolv\.conf|\.git/config|\.git/logs/HEAD"
HANDED_HOST = r"hostname\s*:\s*['\"][a-z0-9-][a-z0-9.-]*(?:\.run\.app|\.web\.app|\.vercel\.app|\.netlify\.app|\.workers\.dev)"
LIFECYCLE = ["postinstall", "preinstall", "install", "prepare", "preuninstall", "postuninstall"]


def content_score(files: DataFrame) -> DataFrame:
    """files (.., content) with base (0, or 65 to 100) and subtype: what a file run by a hook weighs."""
    from tarnwatch.functions import text as T
    from tarnwatch.operators.payloads import PAAS

    c = F.coalesce("content", F.lit(""))
    f = files.withColumns({
        "o": T.is_obfuscated(c), "e": c.rlike(EVALUATES), "n": c.rlike(CONNECTS), "u": c.rlike(ADDRESSES), "v": c.rlike(ENV_SECRETS), "r": c.rlike(READS), "i": c.rlike(IDENTITIES), "paas": c.rlike(PAAS) | c.rlike(HANDED_HOST),
    })
    worst = F.expr("e OR (o AND n)")
    base = F.when(worst | F.col("v"), 90).when(F.expr("r AND i AND n"), 85).when(F.expr("r AND i"), 75).when(F.col("u"), 70).when(F.col("n"), 65).otherwise(0)
    subtype = (
        F.when(worst, "obfuscated_install").when(F.expr("v AND u"), "hidden_preinstall").when(F.col("v"), "encoded_payload_postinstall").when(F.expr("r AND i"), "identity_recon_exfil")
        .when(F.col("u"), "encoded_payload_postinstall").when(F.col("n"), "hook_indirection")
    )
    return f.select(*files.columns, F.when((base > 0) & F.col("paas"), F.least(F.lit(100), base + 15)).otherwise(base).alias("base"), subtype.alias("subtype"))


def hook_chains(packages: DataFrame, files: DataFrame, reputable: DataFrame | None = None) -> DataFrame:
    """Hooks that only hand over to a file, scored by what stands in it, and on to the files it names: package, hook, path,
    score (50 to 100), subtype, severity, chain (files with a score, in order of names after the first), worst (the highest
    score along the chain).

    A name stands for the first file (by path) that it is the end of: files are laid out by their path's ends, so that this
    is an equi-join. A hook whose file weighs nothing has no row."""
    from tarnwatch.operators.detectors import unlisted

    bare = lambda c: F.regexp_replace(c, r"^\.?/", "")
    f = content_score(files.select("package", "path", "content"))
    parts = F.split(bare(F.col("path")), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    by_end = f.select("package", F.explode(ends).alias("name"), "path").groupBy("package", "name").agg(F.min("path").alias("path"))
    h = unlisted(packages, reputable).select("package", F.explode(F.map_entries("scripts")).alias("s")).select("package", F.col("s.key").alias("hook"), F.col("s.value").alias("body"))
    h = h.where(F.col("hook").isin(LIFECYCLE) | F.col("hook").rlike("^(pre|post)"))
    handed = h.select("package", "hook", F.nullif(F.regexp_extract("body", HANDS_OVER, 1), F.lit("")).alias("named")).where("named IS NOT NULL").select("package", "hook", "named", bare(F.col("named")).alias("name"))
    one = handed.join(by_end, ["package", "name"]).join(f, ["package", "path"]).where("base > 0")
    named = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in NAMES_FILES])
    two = one.select("package", "hook", "path", F.explode(F.array_distinct(F.transform(named, bare))).alias("name"))
    two = two.withColumnRenamed("path", "from").join(by_end, ["package", "name"]).join(f.select("package", "path", F.col("base").alias("next")), ["package", "path"]).where("next > 0")
    onward = two.groupBy("package", "hook", F.col("from").alias("path")).agg(F.array_sort(F.collect_set("name")).alias("onward"), F.max("next").alias("next"))
    j = one.join(onward, ["package", "hook", "path"], "left")
    level = F.when(F.col("subtype").isin("obfuscated_install", "hidden_preinstall"), "critical").when((F.col("subtype") == "encoded_payload_postinstall") & F.col("content").rlike(ENV_SECRETS), "critical").when(F.col("subtype") == "hook_indirection", "medium").otherwise("high")
    chain = F.concat_ws(">", F.array("named"), F.coalesce("onward", F.array().cast("array<string>")))
    return j.select("package", "hook", "path", F.greatest(F.lit(50), "base").alias("score"), "subtype", level.alias("severity"), chain.alias("chain"), F.greatest("base", F.coalesce("next", F.lit(0))).alias("worst"))
