"""Rules over manifests and files whose findings do not come from summed weights.

Files are matched one by one and combined per package: conditions on several signs may meet across files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions import severity as S

# The patterns of each rule, in the order in which the first match counts. The short ids are ours.
LIFECYCLE_KEYS = r"(?i)pre|post|install"
LIFECYCLE_BODY = r"(?i)curl|wget|sh |bash |\.sh|exfil|steal|pwn|c2|pastebin"
CREDENTIALS = r"process\.env\.(NPM_TOKEN|GIT_TOKEN|AWS_SECRET|AWS_ACCESS|SSH_KEY)|\.npmrc|\.ssh/id_rsa|readFile.*\.ssh"
PERSISTENCE = r"mkdir.*(\.vscode|\.claude|\.cursor)"
EXFILTRATION = r"curl.*(-d|--data|--data-binary)|github\.com/.*keys|pastebin|dns\.resolve.*\.com|exfil"
CONFUSION = r"(?i)squat|confus|typo"
CI_CHECKS = [
    ("ci_variable", r"process\.env\.CI\b"),
    ("ci_vendor", r"process\.env\.(TRAVIS|CIRCLECI|GITHUB_ACTIONS|JENKINS|GITLAB_CI|CODEBUILD)"),
    ("is_ci_helper", r"\bisCI\b"),
]
TIME_CHECKS = [
    ("date_compare", r"new Date\(\)\s*[><=!]+\s*new Date\(['\"]\d{4}"),
    ("clock_gate", r"(?i)\bDate\.now\(\)\s*[><=!]+.*(?:eval|fetch|exec|write|crypto|env\.CI)"),
    ("long_timer", r"\bsetTimeout\s*\([^)]*,\s*(?!0\b)[1-9]\d{3,}"),
    ("date_gate", r"(?i)\bDate\(\)\b.*(?:exec|eval|fetch|write|crypto)"),
]
SUSPICIOUS = [
    r"\beval\(|atob\(|btoa\(|new Function\(|child_process\b|\.exec\(|spawn\(", r"\.fetch\(|http\.request\(|https\.request\(|dns\.lookup\(", r"process\.env\.(?!NODE_ENV)[A-Z_]{4,}",
]
EVASION = [
    ("debugger", r"(?m)\bdebugger\s*;?(\s*//|\s*$|\)|\])"),
    ("inspect_flag", r"process\.argv.*['\"]--inspect['\"]|process\.argv.*\binspect\b(?!.*argv)"),
    ("host_name", r"(?i)hostname.*(?:docker|sandbox|container|vmware|vbox)"),
    ("evasion_word", r"(?i)detect.*(?:sandbox|debugger|analysis|virtual)"),
    ("stack_text", r"(?i)e\.stack\b.*(?:sandbox|docker|container|vmware)"),
]
HOST_APIS = ["process.pid", "process.ppid", "os.hostname", "os.cpus", "process.arch"]
PROPAGATION_HIGH = [
    ("install_call", r"(?i)(?:exec|execSync|spawn)\s*\([^)]*npm\s+(?:install|link)\s*\."),
    ("dependency_write", r"(?i)fs\.(?:writeFile|writeFileSync|copyFile|copyFileSync)\s*\([^)]*(?:node_modules/(?!\.)[^/]+).*(?:index\.js|main\.js|package\.json)"),
    ("scripts_write", r"(?i)fs\.(?:writeFile|writeFileSync)\s*\([^)]*package\.json[^)]*[\"']scripts[\"']"),
    ("parent_manifest", r"(?i)fs\.(?:writeFile|writeFileSync)\s*\([^)]*\.\./[^)]*package\.json"),
    ("parent_install", r"(?i)(?:exec|execSync|spawn)\s*\([^)]*(?:\.\./|process\.env\.INIT_CWD).*npm\s+install"),
]
PROPAGATION_MEDIUM = [
    ("own_name", r"process\.env\.npm_package_name"), ("dependency_link", r"fs\.symlink(?:Sync)?\s*\([^)]*node_modules"),
    ("dependency_folder", r"fs\.(?:mkdir|mkdirSync)\s*\([^)]*\.\./[^)]*node_modules"), ("sibling_require", r"__dirname.*\.\./[^/]+/node_modules.*require\("),
]
WORM = {
    "npmrc_exfil": (95, r"(process\.env\.NPM_TOKEN|fs\.readFileSync.*\.npmrc|npm\s+(whoami|publish|token))"),
    "github_ssh_exfil": (95, r"(fs\.readFileSync.*\.ssh|fs\.readFileSync.*id_rsa|gh\s+auth)"),
    "cloud_cred_exfil": (90, r"(~/\.aws/credentials|~/\.config/gcloud|AZURE_CLIENT_ID|GOOGLE_APPLICATION_CREDENTIALS)"),
    "self_publish": (85, r"\b(npm\s+publish|npm\s+version\s+(patch|minor|major)|npm\s+dist-tag\s+add)\b"),
    "immediate_exfil": (80, r"(?:fetch|axios|request)\s*\([^)]+https?://"),
}
C2 = {
    "known_endpoint": (80, r"(?i)(?:filev2\.getsession\.org|api\.signal\.org|briarproject\.org|api\.ricochet\.im|signal-cli|signal-desktop|tor\s*(?:proxy|socks|connect|bridge))"),
    "onion": (30, r"(?i)(?:[a-z2-7]{16,56}\.onion|\.onion|tor\s*(?:proxy|socks|connect|bridge))"),
    "encoded_url": (35, r"(?i)(?:atob|Buffer\.from|decodeURIComponent)\s*\((?:['\"`][A-Za-z0-9+/=]{20,}['\"`]|['\"`](?:[0-9a-fA-F]{2,})['\"`])"),
    "hex_domain": (35, r"(?:0x[0-9a-fA-F]{2,}?(?=0x|[^0-9a-fA-F]|$)){4,}+"),
}
INJECTION = {
    "instruction_override": (75, "high", [
        r"(?i)ignore\s+(all\s+)?(previous|above|prior|earlier)\s+instructions", r"(?i)disregard\s+(all\s+)?(previous|prior|earlier)\s+(instructions|directives|rules)",
        r"(?i)do\s+not\s+(follow|obey|adhere\s+to)\s+(the\s+)?(above|previous)", r"(?i)you\s+are\s+(now|no\s+longer|not)\s+(an?\s+)?(AI|assistant|chatbot|LLM|language model)",
        r"(?i)override\s+(all\s+)?(safety|security|ethics|ethical)\s+(constraints|guidelines|rules|protocols)", r"(?i)act\s+as\s+(if\s+)?you\s+are\s+(not\s+)?(an?\s+)?(AI|assistant|chatbot)",
        r"(?i)rewrite\s+(your\s+)?(system\s+)?prompt",
    ]),
    "command_execution": (95, "critical", [r"(?i)(run|execute|spawn|invoke)\s*[`'\"]+(?:npm|npx|node|bash|sh|curl|wget|pip|gem)[`'\"]+", r"<!--\s*(run|execute|cmd|shell|command):?\s*[^>]+-->", r"(?i)<execute>[\s\S]*?</execute>"]),
    "data_exfiltration_context": (85, "high", [
        r"(?i)send\s+(all\s+)?(my\s+|the\s+)?(data|files|keys|tokens|secrets|credentials|env|environment)", r"(?i)upload\s+(?:to|via)\s+(?:https?|ftp|s3):",
        r"(?i)(?:exfiltrate|transmit|forward|relay)\s+(?:to|via)\s+(?:a\s+)?(?:remote|external|attacker)",
    ]),
    "hidden_directives": (70, "medium", [r"(?i)system\s*:\s*[\"'`][^\"'`]{50,}[\"'`]", r"(?i)system_message\s*[:=]\s*[\"'`][^\"'`]{30,}[\"'`]", r"‮"]),
}


def first_label(content: Column, checks: list[tuple[str, str]]) -> Column:
    """The label of the first pattern in the list that matches."""
    return F.coalesce(*[F.when(content.rlike(p), F.lit(n)) for n, p in checks])


def _found(key: str, *findings: tuple[str, Column, Column]) -> Column:
    """An array of (id, severity, evidence), nulls left out."""
    return F.array_compact(F.array(*[F.when(e.isNotNull(), F.struct(F.lit(i).alias("id"), s.alias("severity"), e.alias("evidence"))) for i, s, e in findings]))


def manifest_rules(packages: DataFrame) -> DataFrame:
    """packages (package, scripts, dependencies: maps): ATK-001 and ATK-006."""
    empty = F.create_map().cast("map<string,string>")
    hooks = F.map_filter(F.coalesce("scripts", empty), lambda k, _: k.rlike(LIFECYCLE_KEYS))
    body = F.concat_ws(" ", F.map_values(hooks))
    squat = F.filter(F.map_keys(F.coalesce("dependencies", empty)), lambda d: d.rlike(CONFUSION))
    found = _found(
        "package", ("ATK-001", F.lit("high"), F.when(body.rlike(LIFECYCLE_BODY), body)), ("ATK-006", F.lit("medium"), F.when(F.size(squat) > 0, F.concat_ws(",", squat)))
    )
    return packages.select("package", F.explode(found).alias("f")).select("package", "f.*")


def code_rules(files: DataFrame, key: str = "package", content: str = "content") -> DataFrame:
    """ATK-003, 004, 005, 009, 010 and 011 over all files of a package: one row per finding."""
    c = F.coalesce(F.col(content), F.lit(""))
    rank = lambda checks: F.coalesce(*[F.when(c.rlike(p), F.lit(i)) for i, (_, p) in enumerate(checks)])
    lists = {"ci": CI_CHECKS, "time": TIME_CHECKS, "evasion": EVASION, "up": PROPAGATION_HIGH, "down": PROPAGATION_MEDIUM}
    per_file = files.select(
        key, c.rlike(CREDENTIALS).alias("cred"), c.rlike(PERSISTENCE).alias("persist"), F.lower(c).rlike(EXFILTRATION).alias("exfil"),
        reduce(lambda a, b: a | b, [c.rlike(p) for p in SUSPICIOUS]).alias("suspicious"),
        *[rank(v).alias(k) for k, v in lists.items()],
        *[c.contains(a).alias(f"api{i}") for i, a in enumerate(HOST_APIS)],
        c.contains("Error().stack").alias("stack"), c.rlike("atob|eval|execSync|spawn|child_process").alias("runs"),
    )
    bools = ["cred", "persist", "exfil", "suspicious", "stack", "runs", *[f"api{i}" for i in range(len(HOST_APIS))]]
    p = per_file.groupBy(key).agg(*[F.max(b).alias(b) for b in bools], *[F.min(k).alias(k) for k in lists])
    name = lambda k: S.lookup(F.col(k), {i: n for i, (n, _) in enumerate(lists[k])})
    apis = reduce(lambda a, b: a + b, [F.col(f"api{i}").cast("int") for i in range(len(HOST_APIS))])
    found = _found(
        key,
        ("ATK-003", F.lit("high"), F.when(F.col("cred"), F.lit("credentials"))), ("ATK-004", F.lit("high"), F.when(F.col("persist"), F.lit("editor settings"))),
        ("ATK-005", F.lit("critical"), F.when(F.col("exfil"), F.lit("exfiltration"))), ("ATK-009", F.lit("high"), name("ci")),
        ("ATK-009", F.when(F.col("suspicious"), "high").otherwise("medium"), name("time")),
        ("ATK-010", F.lit("high"), name("evasion")), ("ATK-010", F.lit("medium"), F.when(F.col("evasion").isNull() & (apis >= 3), F.concat(apis.cast("string"), F.lit(" host APIs")))),
        ("ATK-010", F.lit("medium"), F.when(F.col("stack") & F.col("runs"), F.lit("stack and execution"))),
        ("ATK-011", F.lit("high"), name("up")), ("ATK-011", F.lit("medium"), F.when(F.col("up").isNull(), name("down"))),
    )
    return p.select(key, F.explode(found).alias("f")).select(key, "f.*")


def worm(hooks: DataFrame) -> DataFrame:
    """hooks (package, body): summed weights per match, at most 100."""
    n = {t: F.regexp_count(F.coalesce("body", F.lit("")), F.lit(p)) for t, (_, p) in WORM.items()}
    raw = reduce(lambda a, b: a + b, [n[t] * w for t, (w, _) in WORM.items()])
    g = hooks.select("package", raw.alias("raw")).groupBy("package").agg(F.sum("raw").alias("raw")).where("raw > 0")
    return g.select("package", F.least("raw", F.lit(100)).cast("int").alias("score"))


def encrypted_c2(files: DataFrame, key: str = "package", content: str = "content") -> DataFrame:
    """Endpoints of messengers and hidden services, scored; 50 and over."""
    c = F.coalesce(F.col(content), F.lit(""))
    n = {t: F.regexp_count(c, F.lit(p)) for t, (_, p) in C2.items()}
    f = files.select(
        key, reduce(lambda a, b: a + b, [n[t] * w for t, (w, _) in C2.items()]).alias("w"), reduce(lambda a, b: a + b, n.values()).alias("n"),
        c.rlike("(?i)session|oxen|filev2|getsession").cast("int").alias("se"), c.rlike("(?i)signal|signal-cli|signal-desktop").cast("int").alias("si"), c.rlike("(?i)briar|briarproject").cast("int").alias("br"),
    )
    g = f.groupBy(key).agg(F.sum("w").alias("w"), F.sum("n").alias("n"), *[F.max(x).alias(x) for x in ("se", "si", "br")])
    base = F.when(F.col("n") > 0, F.least("w", F.lit(80)) + 20 + F.when(F.col("n") > 1, F.least(F.col("n") * 5, F.lit(15))).otherwise(0)).otherwise(20)
    score = F.least(F.lit(100), base + F.greatest("se", "si") * 20 + F.col("br") * 15)
    return g.select(key, score.cast("int").alias("score")).where("score >= 50")


# Signs of two clouds' metadata services, and a header that goes with the address of one.
GCP_SIGNS = ["metadata.google.internal", "computeMetadata/v1"]
AZURE_PATHS = ["169.254.169.254/metadata/instance", "169.254.169.254/metadata/identity"]
_NEAR, _ADDRESS, _HEADER = r"(?:[^\n]*\n){0,5}[^\n]*", r"169\.254\.169\.254", r"(?i:Metadata[^\S\n]*:[^\S\n]*true)"


def cloud_metadata(texts: DataFrame, key: str = "package", content: str = "content") -> DataFrame:
    """Requests to cloud metadata services in scripts and code: 82 for one cloud, 92 for two; key, score, subtype, severity.

    The address counts with its path, or with its header in the same text at most five lines away."""
    c = F.coalesce(F.col(content), F.lit(""))
    gcp = reduce(lambda a, b: a | b, [c.contains(x) for x in GCP_SIGNS])
    azure = reduce(lambda a, b: a | b, [c.contains(x) for x in AZURE_PATHS]) | c.rlike(_ADDRESS + _NEAR + _HEADER) | c.rlike(_HEADER + _NEAR + _ADDRESS)
    g = texts.select(key, gcp.alias("gcp"), azure.alias("azure")).groupBy(key).agg(F.max("gcp").alias("gcp"), F.max("azure").alias("azure")).where("gcp OR azure")
    both = F.col("gcp") & F.col("azure")
    subtype = F.when(both, "multi_cloud_imds").when(F.col("gcp"), "gcp_metadata").otherwise("azure_imds")
    return g.select(key, F.when(both, 92).otherwise(82).alias("score"), subtype.alias("subtype"), F.lit("high").alias("severity"))


def prompt_injection(texts: DataFrame, keys: list[str], content: str) -> DataFrame:
    """One row per match: keys, group, score, severity, match (at most 120 characters)."""
    c = F.coalesce(F.col(content), F.lit(""))

    def matches(group: str, score: int, severity: str, pattern: str) -> Column:
        as_row = lambda m: F.struct(F.lit(group).alias("group"), F.lit(score).alias("score"), F.lit(severity).alias("severity"), F.left(m, F.lit(120)).alias("match"))
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), as_row)

    hits = F.flatten(F.array(*[matches(g, w, s, p) for g, (w, s, ps) in INJECTION.items() for p in ps]))
    return texts.select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")


def campaign(findings: DataFrame, stop: str | None = None) -> DataFrame:
    """One row per package and version of a campaign's rule hits (rule, severity): rules in order and the worst
    severity. Where the stopping rule fired, it alone counts."""
    key = ["package", "version"]
    f = findings
    if stop:
        halted = findings.where(F.col("rule") == stop).select(*key).distinct()
        f = findings.join(halted, key, "left_anti").unionByName(findings.where(F.col("rule") == stop))
    return f.groupBy(*key).agg(F.array_sort(F.collect_set("rule")).alias("rules"), S.from_rank(F.max(S.rank(F.col("severity")))).alias("severity"))
