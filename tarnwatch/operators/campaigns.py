"""Rules of known campaigns. Each gives hits (package, version, rule, severity) that rules.campaign() rolls up.

packages: package, version, publisher, scripts (map), dependencies (map), first_published, versions (how many);
files: package, path, content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions import severity as S
from tarnwatch.functions import text as T
from tarnwatch.operators.detectors import hooks_of
from tarnwatch.operators.iocs import by_hash
from tarnwatch.operators.payloads import any_of

KEY = ["package", "version"]


def _hits(rows: DataFrame, rule: str, severity: str) -> DataFrame:
    return rows.select(*KEY).distinct().select(*KEY, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def _all(*hits: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, hits)


def _of(packages: DataFrame, rows: DataFrame) -> DataFrame:
    """packages that rows have: of rows with a version (files of several versions) only that one."""
    on = [k for k in KEY if k in rows.columns]
    return packages.select(*KEY).join(rows.select(*on).distinct(), on, "left_semi")


def signs(packages: DataFrame, files: DataFrame, of_file: dict[str, Column], hooks: str | None = None, of_hook: dict[str, Column] | None = None) -> DataFrame:
    """All signs of a campaign in one pass over the contents: package, version, and a boolean per sign.

    of_file: conditions on path and content. Scripts whose hook matches `hooks` count for the signs in of_hook. A sign of a
    file with a version is that version's; without one it is every version's."""
    c = F.coalesce("content", F.lit("")).alias("content")
    on = [k for k in KEY if k in files.columns]
    rows = files.select(*on, "path", c).select(*on, *[F.coalesce(v, F.lit(False)).alias(k) for k, v in of_file.items()])
    seen = rows.groupBy(*on).agg(*[F.max(k).alias(k) for k in of_file])
    found = packages.select(*KEY).distinct().join(seen, on, "left")
    if hooks is not None:
        h = packages.select(*KEY, F.explode(F.map_entries("scripts")).alias("s")).where(F.col("s.key").rlike(hooks)).select(*KEY, F.col("s.key").alias("hook"), F.coalesce("s.value", F.lit("")).alias("content"))
        h = h.select(*KEY, *[F.coalesce(v, F.lit(False)).alias(f"h_{k}") for k, v in of_hook.items()]).groupBy(*KEY).agg(*[F.max(f"h_{k}").alias(f"h_{k}") for k in of_hook])
        found = found.join(h, KEY, "left")
        for k in of_hook:
            own = F.coalesce(F.col(k), F.lit(False)) if k in of_file else F.lit(False)
            found = found.withColumn(k, own | F.coalesce(F.col(f"h_{k}"), F.lit(False))).drop(f"h_{k}")
    return found.select(*KEY, *[F.coalesce(F.col(k), F.lit(False)).alias(k) for k in {**of_file, **(of_hook or {})}])


def fired(found: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Rules (name: severity and condition) over signs as hits, one row each."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, (s, c) in rules.items()]))
    return found.select(*KEY, F.explode(hits).alias("h")).select(*KEY, "h.*").distinct()


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


# Names, markers, sizes and patterns of the campaigns.
TRAPDOOR_PUBLISHER, TRAPDOOR_MARKER, TRAPDOOR_FILE, TRAPDOOR_BYTES = "asdxzxc", "P-2024-001", "trap-core.js", 48_485
TRAPDOOR_C2 = [r"(?i)ddjidd564\.github\.io", r"(?i)gist\.github\.com"]
TRAPDOOR_SECRETS = r"(?i)\.aws/|id_rsa|\.env|keystore|credentials|\.npmrc|\.ssh/"
TRAPDOOR_KEY, TRAPDOOR_BUNDLES = "cargo-build-helper-2026", r"(?i)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml|pnpm-lock\.yml|Cargo\.lock|Cargo\.toml)|\.node$|vendor|native"
TRAPDOOR_TRIES = r"(?i)sts\.amazonaws\.com|api\.github\.com/user"
TRAPDOOR_LURES = r"(?i)solidity|defi|solana|sui\b|move-lang|^eth-|prompt-engineering|token-usage|dev-env-bootstrap"


def trapdoor(packages: DataFrame, files: DataFrame, as_of: str) -> DataFrame:
    """D1 to D9: a marker in notes and scripts, a payload by name or size, a publisher, addresses next to secret paths,
    characters without width in agent rules, lure names younger than 30 days before `as_of`, two ciphers in one text, a key in
    lockfiles or bundled code, and hosts on which stolen credentials are tried."""
    c, base = F.col("content"), base_name(F.col("path"))
    sends = any_of(c, TRAPDOOR_C2) & c.rlike(TRAPDOOR_SECRETS)
    script, ciphers, tries = F.col("path").rlike(r"\.(js|mjs|cjs)$"), c.rlike("(?i)Fernet") & c.rlike(r"(?i)\bECDH\b|\bcreateECDH\b"), c.rlike(TRAPDOOR_TRIES)
    found = signs(
        packages, files,
        {
            "marked": (base.isin(".cursorrules", "CLAUDE.md", "README.md", "package.json") | F.col("path").rlike(r"\.(md|sh|json)$")) & c.contains(TRAPDOOR_MARKER),
            "payload": (base == TRAPDOOR_FILE) | (F.octet_length(c) == TRAPDOOR_BYTES), "sends": script & sends, "ciphers": script & ciphers, "tries": script & tries,
            "keyed": F.replace("path", F.lit("\\"), F.lit("/")).rlike(TRAPDOOR_BUNDLES) & c.contains(TRAPDOOR_KEY),
            "poisoned": F.lower(base).isin(".cursorrules", "claude.md") & (F.size(T.zero_width(c)) > 0),
        },
        "preinstall|install|postinstall|prepare", {"sends": sends, "ciphers": ciphers, "tries": tries},
    )
    young = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("first_published").cast("timestamp")) < 30 * 86_400_000_000
    lure = packages.where(F.col("package").rlike(TRAPDOOR_LURES) & young & (F.col("versions") <= 2))
    return _all(
        fired(found, {"D1": ("critical", F.col("marked")), "D2": ("critical", F.col("payload")), "D4": ("critical", F.col("sends")), "D5": ("high", F.col("poisoned")), "D7": ("high", F.col("ciphers")), "D8": ("high", F.col("keyed")), "D9": ("critical", F.col("tries"))}),
        _hits(packages.where(F.col("publisher") == TRAPDOOR_PUBLISHER), "D3", "critical"), _hits(lure, "D6", "medium"),
    )


# Versions, a decoy, and the signs of code in a hook and of what it plants.
POISONED_VERSIONS = {"axios": ["1.14.1", "0.30.4"]}
DECOYS = ["plain-crypto-js"]
HOOK_CODE = [
    r"curl|wget|fetch|https?://", r"powershell|cmd\.exe|bash\b|sh\b", r"process\.exit|fs\.chmod|exec(?:Sync)?\s*\(", r"spawn|fork|detached", r"systemd|launchctl|crontab|schtasks",
    r"LoadLibrary|dlopen", r"eval|Function\s*\(", r"__dirname|__filename",
]
PLANTED = {
    "temp": r"os\.tmpdir|tmpdir|temp|%TEMP%|/tmp|/var/tmp", "powershell": r"powershell|pwsh|cmd\.exe|Invoke-Expression|IEX\s*\(", "launchd": r"/Library/Launch(Daemons|Agents)/|launchctl\s+(load|start|submit)",
    "services": r"/etc/systemd/system/|systemctl\s+(enable|start|daemon-reload)|crontab\s+-[ei]|@reboot\s+|@daily\s+|@hourly\s+", "loads": r"LoadLibrary|dlopen",
    "injects": r"CreateRemoteThread|VirtualAllocEx|WriteProcessMemory|NtCreateThreadEx", "calls": r"(?:https?://|wss?://)(?:[^\s'\"]*\.[^\s'\"]{2,})",
    "drops": r"(?:fs\.writeFileSync|writeFile|writeFileSync)\s*\([^)]*(?:\.exe|\.dll|\.bin|\.bat|\.ps1)",
}


def planted_payloads(packages: DataFrame, files: DataFrame) -> DataFrame:
    """What packages with install hooks plant, over hooks and files together: package, version, payload, platforms.

    A dropped binary is a cross_platform_rat with two platforms and a callback, else a network_backdoor with a callback, else
    platform_persistence with a platform. Without code in the hooks or files, or a dropped binary, there is none."""
    c, hook = F.col("content"), "^(postinstall|install|preinstall)$"
    of = {n: c.rlike(p) for n, p in PLANTED.items()} | {"code": any_of(c, HOOK_CODE)}
    hooked = packages.where(F.exists(F.map_keys(F.coalesce("scripts", F.create_map().cast("map<string,string>"))), lambda k: k.rlike(hook)))
    s = signs(hooked, files, of, hook, of).where("code AND drops")
    all_ = F.expr("temp AND (powershell OR drops)")
    on = {"windows": F.expr("powershell OR loads OR injects") | all_, "linux": F.col("services") | all_, "macos": F.col("launchd") | all_}
    platforms = F.array_compact(F.array(*[F.when(v, F.lit(n)) for n, v in sorted(on.items())]))
    payload = F.when((F.size("platforms") >= 2) & F.col("calls"), "cross_platform_rat").when(F.col("calls"), "network_backdoor").when(F.size("platforms") > 0, "platform_persistence")
    return s.withColumn("platforms", platforms).withColumn("payload", payload).where("payload IS NOT NULL").select(*KEY, "payload", F.array_join("platforms", ",").alias("platforms"))


def poisoned_client(packages: DataFrame, files: DataFrame) -> DataFrame:
    """D1 a poisoned version, which stops the other rules; D2 a decoy dependency; D3 hooks that plant a payload."""
    bad = reduce(lambda a, b: a | b, [(F.col("package") == n) & F.col("version").isin(v) for n, v in POISONED_VERSIONS.items()])
    decoy = packages.where(F.arrays_overlap(F.map_keys("dependencies"), F.array(*[F.lit(d) for d in DECOYS])))
    return _all(_hits(packages.where(bad), "D1", "critical"), _hits(decoy, "D2", "critical"), _hits(planted_payloads(packages, files), "D3", "critical"))


# An account and the names it copied, and the secrets its loader reads.
COPYING_ACCOUNT = "vpmdhaj"
COPIED = ["opensearch-setup", "env-config-manager", "express", "lodash", "axios", "react", "vue", "angular", "babel", "webpack", "typescript", "moment", "dotenv"]
CLOUD_SECRETS = [
    r"169\.254\.169\.254", r"AWS_CONTAINER_AUTHORIZATION_TOKEN|AWS_CONTAINER_CREDENTIALS_FULL_URI", r"VAULT_ADDR|VAULT_TOKEN", r"GITHUB_TOKEN|GH_TOKEN",
    r"AWS_ACCESS_KEY_ID|AWS_SECRET_ACCESS_KEY|AWS_SESSION_TOKEN",
]


def copied_names(packages: DataFrame, files: DataFrame) -> DataFrame:
    """D1S the account or its namespace, which stops the other rules; D1 names that contain a copied one and are within
    two edits of it, or hold words of it; D2 any preinstall script; D3 files that read secrets of clouds."""
    name = F.lower("package")
    near = reduce(lambda a, b: a | b, [F.contains("package", F.lit(t)) & (F.col("package") != t) & ~F.col("package").startswith("@") & (F.levenshtein(name, F.lit(t), 2) > 0) for t in COPIED])
    alias = packages.where(near | name.contains("opensearch") | name.contains("env-config") | name.contains("envconfig"))
    account = packages.where((F.col("publisher") == COPYING_ACCOUNT) | F.col("package").startswith(COPYING_ACCOUNT + "-"))
    return _all(
        _hits(account, "D1S", "critical"), _hits(alias, "D1", "critical"), _hits(_of(packages, hooks_of(packages, "^preinstall$")), "D2", "critical"),
        _hits(_of(packages, files.where(any_of(F.coalesce("content", F.lit("")), CLOUD_SECRETS))), "D3", "critical"),
    )


# A marker module, and signs of persistence, of a locale switch and of a dead drop.
SCRAMBLE = r"require\(['\"]ctf-scramble-v\d+['\"]\)|(?:from|import)\s+['\"]ctf-scramble-v\d+['\"]"
PERSISTS = [
    r"\b(daemon|fork)\s*\(", r"spawn\s*\([^)]*detached\s*:\s*true", r"/etc/systemd/system/|systemctl\s+(enable|start)", r"crontab\s+-e|/etc/cron\b", r"/Library/LaunchDaemons/|launchctl\s+(load|start)",
    r"schtasks\.exe|New-ScheduledTask|Register-ScheduledJob",
]
LOCALE = r"process\.env\.(LANG|LC_ALL|LC_MESSAGES)|Intl\.DateTimeFormat\(\)\.resolvedOptions\(\)\.timeZone|Intl\.DateTimeFormat\.resolvedOptions\b"
LOCALE_SWITCH = r"ru_RU|be_BY|uk_UA|process\.exit\s*\(\s*0\s*\)"
DROP_WORD, HUB_API = "OhNoWhatsGoingOnWithGitHub", r"api\.github\.com/repos/[^/]+/[^/]+/commits|api\.github\.com/graphql"
HUB_TOKEN, COMMIT_LOOP = r"process\.env\.(?:GH_TOKEN|GITHUB_TOKEN|GITHUB_ACTOR)", r"commits?\s*\.\s*(?:map|filter|forEach|for\s*\(|while\s*\()"


def scrambled_worm(packages: DataFrame, files: DataFrame) -> DataFrame:
    """D1 a scrambling module, which stops the other rules; D2 persistence in files or install scripts; D3 a switch by
    locale; D4 a dead drop in commits. Signs of D3 and D4 may stand in different files of a package."""
    c = F.col("content")
    stays = any_of(c, PERSISTS)
    texts = {"scramble": SCRAMBLE, "at": LOCALE, "off": LOCALE_SWITCH, "api": HUB_API, "token": HUB_TOKEN, "loop": COMMIT_LOOP, "word": DROP_WORD}
    found = signs(packages, files, {n: c.rlike(p) for n, p in texts.items()} | {"stays": stays}, "^(preinstall|install|postinstall|preuninstall|postuninstall)$", {"stays": stays})
    drop = F.col("word") | (F.col("api") & (F.col("token") | F.col("loop")))
    return fired(found, {"D1": ("critical", F.col("scramble")), "D2": ("critical", F.col("stays")), "D3": ("high", F.col("at") & F.col("off")), "D4": ("critical", drop)})


# Versions, hosts and an account of a hijacked module.
HIJACKED, HIJACKED_VERSIONS, HIJACKER = "node-ipc", ["9.1.6", "9.2.3", "12.0.1"], "atiertant"
RESOLVER = r"\bdns\.promises\s*\.\s*Resolver\b"
RESOLVER_ADDRESS = r"setServers\(\s*\[?\s*['\"`](\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})['\"`]"
PUBLIC_RESOLVERS = ["1.1.1.1", "8.8.8.8", "8.8.4.4", "9.9.9.9"]
HIJACK_HOSTS = r"(?i)sh\.azurestaticprovider\.net|37\.16\.75\.69"
HIJACK_ZONE = r"(?i:bt\.node\.js)|\bresolveTxt\s*\("


def hijacked_module(packages: DataFrame, files: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """D1 versions; D2 file hashes (sha256); D5 a resolver of its own; D6 hosts; D7 names over DNS text records; D8 work at
    load time (info); D9 leftovers under ~/nt-*; D10 the account; D11 lockfiles that hold a bad version."""
    c, path = F.col("content"), F.col("path")
    scripted = path.rlike(r"\.(js|mjs|cjs)$")
    address = F.regexp_extract(c, RESOLVER_ADDRESS, 1)
    own, zone, late, hosts = c.rlike(RESOLVER) & (address != "") & ~address.isin(PUBLIC_RESOLVERS), c.rlike(HIJACK_ZONE), c.rlike(r"\bsetImmediate\s*\("), c.rlike(HIJACK_HOSTS)
    lock = path.rlike(r"(?i)(package-lock\.json|yarn\.lock|pnpm-lock\.ya?ml)$") & c.rlike(r"(?i)\bnode-ipc\b") & any_of(c, [f'"{v}"'.replace(".", r"\.") for v in HIJACKED_VERSIONS])
    install = F.col("hook").rlike("preinstall|install|postinstall|prepare")
    found = signs(
        packages, files, {"own": scripted & own, "hosts": hosts, "zone": scripted & zone, "late": scripted & late, "left": path.rlike(r"~/nt-[\w-]+/.*\.tar\.gz"), "lock": lock},
        "", {"own": install & own, "hosts": hosts, "zone": install & zone, "late": late},
    )
    named = packages.where(F.col("package") == HIJACKED)
    rules = {"D5": ("critical", "own"), "D6": ("critical", "hosts"), "D7": ("critical", "zone"), "D8": ("info", "late"), "D9": ("critical", "left"), "D11": ("critical", "lock")}
    hits = [
        fired(found, {r: (s, F.col(k)) for r, (s, k) in rules.items()}),
        _hits(named.where(F.col("version").isin(HIJACKED_VERSIONS)), "D1", "critical"), _hits(named.where(F.col("publisher") == HIJACKER), "D10", "critical"),
    ]
    if hashes is not None:
        hits.append(_hits(_of(packages, by_hash(files.withColumn("content", F.coalesce("content", F.lit(""))), hashes, "content")), "D2", "critical"))
    return _all(*hits)


# The package and its first safe release.
BAD_HOST_PACKAGE, SAFE_RELEASE = "starlette", (1, 0, 1)


def bad_host_requirements(requirements: DataFrame) -> DataFrame:
    """requirements (path, name, operator, version): files that ask for the package below its first safe release, by the
    version they name first, or without one."""
    r = requirements.where(F.col("name") == BAD_HOST_PACKAGE)
    safe = F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(("major", "minor", "micro"), SAFE_RELEASE, strict=True)])
    kind = F.when(F.col("version").isNull(), "unpinned").when(T.release(F.col("version")) < safe, "unsafe")
    return r.withColumn("kind", kind).where("kind IS NOT NULL").select("path", "version", "kind")


# Packages that bring the bad package along, at first and at second hand, and a version of one that does not.
BAD_HOST_TIERS = {1: ["fastapi", "vllm", "litellm", "bentoml", "text-generation-inference", "ray-serve"], 2: ["langserve", "fastapi-mcp", "mcp", "starlette-admin", "piccolo-api", "fastapi-users", "broadcaster"]}
SAFE_CARRIER = ("fastapi", (0, 116, 0))


def bad_host_tiers(requirements: DataFrame) -> DataFrame:
    """requirements (project, line, name, operator, version): of each project that does not pin the bad package to a safe
    release, the first package of tier 1 that it names, else of tier 2: project, package, tier.

    Only plain names, == and >= count; of fastapi an == of a safe release is passed over. Extras count as their package."""
    r = requirements.where("operator IS NULL OR operator IN ('==', '>=')")
    at = lambda v: F.struct(*[F.lit(x).cast("long").alias(n) for n, x in zip(("major", "minor", "micro"), v, strict=True)])
    first = requirements.where(F.col("name") == BAD_HOST_PACKAGE).groupBy("project").agg(F.min_by(F.struct("version"), "line").alias("f"))
    pinned = first.where(F.col("f.version").isNotNull() & (T.release(F.col("f.version")) >= at(SAFE_RELEASE))).select("project")
    safe = r.where((F.col("name") == SAFE_CARRIER[0]) & (F.col("operator") == "==")).groupBy("project").agg(F.min_by("version", "line").alias("v")).where(T.release(F.col("v")) >= at(SAFE_CARRIER[1])).select("project", F.lit(SAFE_CARRIER[0]).alias("name"))
    tier = F.when(F.col("name").isin(BAD_HOST_TIERS[1]), 1).when(F.col("name").isin(BAD_HOST_TIERS[2]), 2)
    found = r.withColumn("tier", tier).where("tier IS NOT NULL").join(pinned, "project", "left_anti").join(safe, ["project", "name"], "left_anti")
    return found.groupBy("project").agg(F.min(F.struct("tier", "line", "name")).alias("f")).select("project", F.col("f.name").alias("package"), F.col("f.tier").alias("tier"))


# Signs in the files of editor extensions.
EXTENSION_SIGNS = {
    "commit_by_hash": r"api\.github\.com/repos/[^/]+/[^/]+/git/commits/[a-f0-9]{40}", "npx_git": r"npx\s+.*github\.com.*#[a-f0-9]{8,}", "agent_words": r"(?i)\b(?:mcp|model-context-protocol|claude|setup|init)\b",
    "fetches": r"(?:fetch|curl|wget)\s*\(?\s*[\"']https?://(?!(?:.*npmjs\.org|.*npm\.js\.org|.*github\.com))[^\"']+", "installs_bun": r"bun\s+install|install\s+.*bun|\bbunx\b|\.bun/bin/",
    "credentials": r"~/\.npmrc|~/\.gitconfig|~/\.aws/credentials|~/\.ssh/id_\w+|~/\.vault-token|~/\.claude/settings\.json|~/Library/Application\s+Support/1Password/|/etc/vault/token|/proc/\*/mem|\$GITHUB_ENV|\$GITHUB_TOKEN|\$NPM_TOKEN|\$NODE_AUTH_TOKEN|GH_TOKEN",
    "channel": r"(?i:[a-z0-9_-]{40,}\.[a-z0-9_-]+\.(?:com|io|org|net|app|dev|xyz))|(?i:/gists\b.*authorization)|(?i:/repos/[^/]+/[^/]+/git/refs)|AES-256-GCM|RSA/(?:PKCS|OAEP)",
    "evades": r"os\.cpus\(\)\.length\s*<\s*4|Intl\.DateTimeFormat.*(?:timeZone|locale)|(?i:Intl\.DateTimeFormat.*\b(?:ru|rus|kz|by|cn|cns)\b)|\bspawn\(\s*[^,]+,\s*\{[^}]*detached:\s*true\s*\}|\bBUN_INSTALL\b|~/\.bun/bin/bun|\bBun\.file\(|\bBun\.serve\(",
}
EXTENSION_WEIGHT = {"known_ioc": "critical", "orphan_commit": "critical", "burst": "high", "publisher": "high", "exfiltration": "high", "activation": "high"}


def extension_files(files: DataFrame, key: str = "extension") -> DataFrame:
    """Signals of extension files (content), one scan: key, signal (orphan_commit or exfiltration)."""
    c = F.coalesce("content", F.lit(""))
    s = {n: c.rlike(p) for n, p in EXTENSION_SIGNS.items()}
    orphan = s["commit_by_hash"] | s["npx_git"] | (s["agent_words"] & s["fetches"]) | s["installs_bun"]
    g = files.select(key, orphan.alias("o"), (s["credentials"] | s["channel"] | s["evades"]).alias("e")).groupBy(key).agg(F.max("o").alias("o"), F.max("e").alias("e"))
    return g.select(key, F.explode(F.array_compact(F.array(F.when(F.col("o"), "orphan_commit"), F.when(F.col("e"), "exfiltration")))).alias("signal"))


#: The workflow campaign's signals.
WORKFLOW_WEIGHT = {
    "secret_exfiltration": "critical", "decode_chain": "critical", "publish_velocity": "critical", "publisher_drift": "critical", "credential_harvest": "high", "bot_commit_identity": "medium", "date_anachronism": "medium",
}


def signal_campaign(signals: DataFrame, weight: dict[str, str] = EXTENSION_WEIGHT, key: str = "extension") -> DataFrame:
    """Signals (key, signal), from wherever they come, as one row each: key, signals, and the worst severity of those that
    have a weight. Others do not count."""
    known = signals.where(F.col("signal").isin(list(weight)))
    g = known.groupBy(key).agg(F.array_sort(F.collect_set("signal")).alias("signals"), F.max(S.rank(S.lookup(F.col("signal"), weight))).alias("worst"))
    return g.select(key, F.array_join("signals", ",").alias("signals"), S.from_rank(F.col("worst")).alias("severity"))
