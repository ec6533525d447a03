"""Rules over the code of a package that name one finding: hidden payloads, stolen data, a repository of another name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions import text as T
from tarnwatch.operators.detectors import unlisted

# Signs of code that decodes and runs, in the order in which they count.
RUNS = r"eval\(|new Function\(|\bFunction\('"
HEX_DECODE = r"Buffer\.from\(['\"`][0-9a-f]+['\"`],\s*['\"]hex['\"]"
B64_DECODE = r"atob\(|Buffer\.from\([A-Za-z0-9+/=]{10,}"
B64_OTHER = r"(?s)try\s*\{[^}]*atob\s*\(|btoa\(.*\)\s*[^;]*\.replace\("
NET_WORDS = r"url|fetch|curl|http\.request|https\.request"
NET_HIDDEN = r"(?s)atob\(.*(https?://|\\x|http).*\)|Buffer\.from\(['\"`][0-9a-f]+['\"`],\s*['\"]hex['\"].*fetch\(|fetch\(.*atob\("
CHAR_CODES = r"String\.fromCharCode\(.{20,}\)"
SHELL_CODE = [
    ("env-eval", r"eval\s*\(\s*process\.env\.[A-Z_]{4,}"), ("exec-buffer", r"exec\s*\(\s*Buffer\.from\("), ("function-eval", r"new Function\s*\(\s*(?:atob|process\.env)"),
    ("require-eval", r"eval\s*\(\s*(?:require|import\s*\()"), ("strict-eval", r"Function\s*\(\s*'use\s*strict'\s*;?\s*(?:atob|require)"),
]
HOOK_SCRIPTS = ["install", "postinstall", "preinstall", "prepare", "prepack", "postpack"]


def hidden_payload(files: DataFrame, packages: DataFrame) -> DataFrame:
    """ATK-002. files (package, path, content), packages (package, scripts): per package the finding of its first file,
    by path, that decodes and runs code, with where it stands, how it is encoded, what it decodes to, the first address,
    and the context that suppression asks for."""
    c, path = F.coalesce(F.col("content"), F.lit("")), F.col("path")
    runs = c.rlike(RUNS)
    hexed, b64 = c.rlike(HEX_DECODE), c.rlike(B64_DECODE) | c.rlike(B64_OTHER)
    kinds = [
        ("hex_payload", "medium", RUNS, runs & hexed), ("base64_payload", "medium", RUNS, runs & b64),
        ("hidden_network", "medium", r"atob\(|Buffer\.from", c.rlike(r"atob\(|Buffer\.from") & c.rlike(NET_WORDS) & c.rlike(NET_HIDDEN)),
        ("char_codes", "medium", r"String\.fromCharCode\(", runs & c.rlike(CHAR_CODES)), *[(n, "high", p, c.rlike(p)) for n, p in SHELL_CODE],
    ]
    found = F.coalesce(*[
        F.when(hit, F.struct(F.lit(n).alias("kind"), F.lit(s).alias("severity"), T.line_of(c, p).alias("line"))) for n, s, p, hit in kinds
    ])
    host = T.first_host(c)
    f = files.select("package", "path", "content", F.explode(F.array_compact(F.array(found))).alias("found")).select(
        "package", "path", "found.*", T.encoding_type(c).alias("encoding_type"), T.decode_preview(c).alias("decoded_preview"), host.alias("url_domain"),
        T.is_safe_domain(host).alias("is_known_safe_domain"), T.is_dist_build(path).alias("is_dist_build"), T.is_test_fixture(path).alias("is_test_fixture"),
    )
    one = f.groupBy("package").agg(F.min_by(F.struct(*[x for x in f.columns if x != "package"]), "path").alias("f")).select("package", "f.*")
    # A file is part of a hook if a hook's script names it, or by its own name.
    scripts = packages.select("package", F.array_compact(F.array(*[F.try_element_at("scripts", F.lit(h)) for h in HOOK_SCRIPTS])).alias("bodies"))
    base = F.element_at(F.split("path", "/"), -1)
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^node_modules/", ""), "^dist/", ""), "^build/", "")
    run = lambda v: F.regexp_extract(v, r"[^\s'\"]+\.js$", 0)
    named = F.exists("bodies", lambda v: F.contains(v, F.col("path")) | F.contains(v, base) | F.contains(v, short) | ((run(v) != "") & F.endswith(F.col("path"), run(v))))
    stem = F.regexp_replace(base, r"\.js$", "")
    hook = F.coalesce(named, F.lit(False)) | stem.isin(*HOOK_SCRIPTS, "setup", "install-helper")
    return one.join(scripts, "package", "left").select(F.lit("ATK-002").alias("atk_id"), *one.columns, hook.alias("is_lifecycle_hook"))


# Signs of files that read, send and hold what is secret.
FS_READ = r"fs\.(?:readFile|readFileSync|readdir|readdirSync)\s*\("
HTTP_FETCH = r"\b(?:fetch|axios|got|superagent|request)\s*\("
FETCH_TOOLS = r"(?i)\b(?:curl|wget|powershell)\s+"
CHILD_PROCESS = r"\b(?:exec|execSync|execFile|execFileSync|spawn|spawnSync|fork)\s*\("
ADDRESS = r"(?i)https?://([^'\"\s)\];,\n\r]+)"
SECRETS = [("cred_regex_aws", r"AKIA[0-9A-Z]{16}"), ("cred_regex_npm_token", r"npm_[a-zA-Z0-9]{36}"), ("cred_regex_gh_token", r"ghp_[a-zA-Z0-9]{30,40}")]
ENV_DUMP = r"process\.env\.(?:AWS_[A-Z_]+|NPM_TOKEN|NPM_AUTH_TOKEN|GIT_TOKEN|SSH_KEY)"
IDENTITY = r"\.gitconfig|\.ssh/|\.aws/config|\.config/git/config|\.config/gcloud/properties|resolv\.conf|['\"`](?:\.git/config|\.git/logs/HEAD)[`'\"]"
GIT_CONFIG = r"(?:exec|execSync|spawn|spawnSync)\s*\(\s*['\"]git['\"]\s*,\s*\[\s*['\"]config['\"]|(?:exec|execSync)\s*\(\s*['\"]git\s+config\b"
PAAS = r"(?i)https?://([a-z0-9-][a-z0-9.-]*(?:\.run\.app|\.web\.app|\.vercel\.app|\.netlify\.app|\.workers\.dev))"
NAMED = "Miasma: The Spreading Blight"


def paas_domains(content: Column) -> Column:
    """Hosts of serverless platforms a text names, each once."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit(PAAS), F.lit(1)))


def infostealer(files: DataFrame, packages: DataFrame, reputable: DataFrame | None = None) -> DataFrame:
    """Files that read and send, hold credentials, dump the environment or read identities, one row per package: score,
    subtype (of the strongest sign, first by path), severity and how many files take part. A named signature anywhere
    is a finding of its own. Whether a file parses is not asked, so no package is let off for files that do not."""
    own = unlisted(packages, reputable)
    f = files.join(own.select("package"), "package", "left_semi")
    c = F.coalesce(F.col("content"), F.lit(""))
    addresses = F.regexp_extract_all(c, F.lit(ADDRESS), F.lit(1))
    outside = F.filter(addresses, lambda d: ~d.rlike(r"(?i)npmjs\.(?:com|org)"))
    hub = F.filter(outside, lambda d: d.rlike(r"(?i)github\.com"))
    to_hub = (F.size(hub) > 0) & (F.size(hub) == F.size(outside))
    sends = c.rlike(FS_READ) & (c.rlike(HTTP_FETCH) | c.rlike(CHILD_PROCESS) | c.rlike(FETCH_TOOLS))
    secret = F.coalesce(*[F.when(c.rlike(p), F.lit(n)) for n, p in SECRETS])
    other = F.when(sends, F.when(to_hub, "nw_exfil_to_github").otherwise("fs_exfil")).when(c.rlike(ENV_DUMP), "env_dump").when(c.rlike(IDENTITY) | c.rlike(GIT_CONFIG), "identity_recon_exfil")
    hits = f.select("package", "path", c.alias("c"), secret.alias("secret"), other.alias("other")).where("secret IS NOT NULL OR other IS NOT NULL")
    hits = hits.select("package", "path", "secret", "other", (T.is_dense(F.col("c")) | F.col("c").rlike(r"\beval\s*\(|\bFunction\s*\(")).alias("hidden"), (F.size(paas_domains(F.col("c"))) > 0).alias("paas"))
    g = hits.groupBy("package").agg(
        F.min_by("secret", F.when(F.col("secret").isNotNull(), F.col("path"))).alias("secret"), F.min_by("other", F.when(F.col("other").isNotNull(), F.col("path"))).alias("other"),
        F.max("hidden").alias("hidden"), F.max("paas").alias("paas"), F.countDistinct("path").alias("files"),
    )
    score = F.when(F.col("secret").isNotNull(), 100).otherwise(80) + F.when(F.col("hidden"), 15).otherwise(0)
    score = F.when(F.col("files") > 1, F.least(F.lit(100), F.round(score * 1.3))).otherwise(score)
    score = F.when(F.col("paas"), F.least(F.lit(100), score + 15)).otherwise(score)
    score = F.greatest(F.lit(50), F.least(F.lit(100), score)).cast("int")
    found = g.select("package", score.alias("score"), F.coalesce("secret", "other").alias("subtype"), F.when(F.col("secret").isNotNull(), "critical").otherwise("high").alias("severity"), F.col("files").cast("long").alias("files"))
    texts = files.select("package", "content").unionByName(packages.select("package", F.explode(F.map_values("scripts")).alias("content")))
    named = texts.where(F.contains("content", F.lit(NAMED))).select("package").distinct().join(own.select("package"), "package", "left_semi")
    named = named.select("package", F.lit(98).alias("score"), F.lit("named_signature_miasma").alias("subtype"), F.lit("critical").alias("severity"), F.lit(0).cast("long").alias("files"))
    return found.join(named.select("package"), "package", "left_anti").unionByName(named)


# Where well-known packages are kept.
KNOWN_REPOSITORIES = {
    "lodash": "lodash/lodash", "chalk": "chalk/chalk", "react": "facebook/react", "axios": "axios/axios", "express": "expressjs/express", "vue": "vuejs/core",
    "typescript": "microsoft/typescript", "moment": "moment/moment", "uuid": "uuidjs/uuid", "commander": "tj/commander.js", "debug": "debug-js/debug", "semver": "npm/node-semver",
    "underscore": "jashkenas/underscore", "request": "request/request", "async": "caolan/async", "cheerio": "cheeriojs/cheerio", "bluebird": "petkaantonov/bluebird",
    "jest": "jestjs/jest", "mocha": "mochajs/mocha", "dotenv": "motdotla/dotenv", "glob": "isaacs/node-glob",
}


def repository_mismatch(packages: DataFrame, files: DataFrame) -> DataFrame:
    """ATK-008. packages (package, repository): a repository of another name than the package, where it is known where
    that package is kept (high); and addresses after "Source:" in comments that the repository does not name (medium)."""
    known = F.create_map(*[F.lit(x) for kv in KNOWN_REPOSITORIES.items() for x in kv])
    repo = F.lower(F.regexp_extract("repository", r"github\.com[/:]([\w.-]+/[\w.-]+?)(?:\.git)?$", 1))
    name, short = F.lower("package"), F.element_at(F.split(F.lower("package"), "/"), -1)
    p = packages.where(F.coalesce("repository", F.lit("")) != "").select("package", "repository", repo.alias("repo"), F.coalesce(known[name], known[short]).alias("expected"), short.alias("short"))
    moved = p.where((F.col("repo") != "") & (F.element_at(F.split("repo", "/"), -1) != F.col("short")) & (F.col("expected") != F.col("repo")))
    out = moved.select("package", F.lit("ATK-008").alias("atk_id"), F.lit("high").alias("severity"), F.concat(F.col("repo"), F.lit(" for "), F.col("expected")).alias("evidence"))
    said = files.select("package", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)//\s*Source:\s*(https?://[^\s]+)"), F.lit(1))).alias("said"))
    host = F.lower(F.regexp_extract("said", r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    odd = said.join(p.select("package", "repository"), "package").where((host != "") & ~F.contains("repository", host))
    return out.unionByName(odd.select("package", F.lit("ATK-008").alias("atk_id"), F.lit("medium").alias("severity"), F.col("said").alias("evidence")))


def any_of(content: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [content.rlike(p) for p in patterns])
