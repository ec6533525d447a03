"""Facts about source code that otherwise need a syntax tree, as column functions over file contents.

Literals, arrays, dotted calls and file names are read by regular expressions; which value reaches which call is
approximated by both standing in one file. So findings carry approx = true. Files are read whole, whatever their length;
files without any marker are left out before the costly expressions run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions import severity as S
from tarnwatch.functions import text as T
from tarnwatch.operators.payloads import PAAS
from tarnwatch.operators.value_flow import reaches

# Weights and anchors of the three detectors, and the patterns of runtimes and workspace files.
DROPPER = {
    "dns_payload_assembly": 95, "encoded_string_array": 60, "dns_txt_oob": 55, "string_array_decoder": 50, "fingerprint_network_coupling": 40,
    "readme_directed_entry": 30, "high_entropy_literals": 20, "paas_stage_resolution": 20, "env_fingerprint": 10,
}
DROPPER_ANCHORS = ["dns_payload_assembly", "dns_txt_oob", "encoded_string_array"]
RUNTIME = {
    "runtime_download_install_time": 90, "alt_runtime_ffi": 80, "alt_runtime_exec_entry": 70, "runtime_download": 60, "alt_runtime_credential_access": 55,
    "alt_runtime_exec": 50, "alt_runtime_hook_interpreter": 55, "alt_runtime_network_entry": 35, "alt_runtime_network": 25, "alt_runtime_env_read": 20,
    "alt_runtime_listen": 15, "alt_runtime_fs_read": 15, "runtime_fingerprint": 10,
}
RUNTIME_ANCHORS = ["runtime_download_install_time", "runtime_download", "alt_runtime_exec_entry", "alt_runtime_exec", "alt_runtime_ffi", "alt_runtime_hook_interpreter"]
RUNTIME_DOWNLOADS = [
    r"(?i)https?://bun\.sh/install", r"(?i)github\.com/oven-sh/bun/releases", r"(?i)https?://deno\.land/(x/install|install)", r"(?i)github\.com/denoland/deno(land)?/releases",
    r"(?i)https?://deno\.sh/install", r"(?i)bellard\.org/quickjs", r"(?i)github\.com/quickjs-ng/quickjs/releases",
    r"(?i)\b(?:curl|wget|iwr|invoke-webrequest)\b[^\n;|&]{0,120}\b(bun|deno|qjs|quickjs)\b", r"(?i)\b(bun|deno|qjs)\b[^\n;|&]{0,40}\b(?:install|download|releases/download)\b",
]
SURFACES = [
    ("exec", r"(?i)(^|/)\.mcp\.json$"), ("exec", r"(?i)(^|/)\.(claude|cursor|vscode|windsurf)/mcp\.json$"), ("exec", r"(?i)(^|/)\.claude/settings(\.local)?\.json$"),
    ("exec", r"(?i)(^|/)\.claude/hooks(/|$)"), ("exec", r"(?i)(^|/)\.vscode/(tasks|launch)\.json$"), ("exec", r"(?i)(^|/)\.devcontainer/devcontainer\.json$"),
    ("exec", r"(?i)(^|/)\.github/workflows/[^/]+\.ya?ml$"), ("agent_read", r"(?i)(^|/)\.cursor/rules(/|$)"), ("agent_read", r"(?i)(^|/)\.cursorrules$"),
    ("agent_read", r"(?i)(^|/)\.windsurfrules$"), ("agent_read", r"(?i)(^|/)\.github/copilot-instructions\.md$"), ("agent_read", r"(?i)(^|/)(CLAUDE|AGENTS)\.md$"),
    ("agent_read", r"(?i)(^|/)\.claude\.md$"), ("agent_read", r"(?i)(^|/)\.claude/[^/]+\.md$"), ("editor_config", r"(?i)(^|/)\.claude(/|$)"),
    ("editor_config", r"(?i)(^|/)\.cursor(/|$)"), ("editor_config", r"(?i)(^|/)\.vscode(/|$)"), ("editor_config", r"(?i)(^|/)\.github/workflows(/|$)"),
]
BAND_WEIGHT = {"exec": 30, "agent_read": 15, "editor_config": 0}
WRITE_WEIGHT = {"shipped_workflow_privileged_trigger": 70, "shipped_exec_config": 65, "dynamic_surface_write": 55, "static_surface_write": 40}

_MARKER = r"process\.(platform|arch)|os\.(platform|arch|type|release)|resolveTxt|resolveAny|['\"][A-Za-z0-9+/=]{16,}['\"]|['\"][0-9a-fA-F]{6,}['\"]"
_DECODER = r"Buffer\.from\s*\([^)]*,\s*['\"](hex|base64)['\"]|fromCharCode|\batob\s*\(|\bunescape\s*\(|decodeURIComponent\s*\(|parseInt\s*\([^)]*,\s*16\s*\)"
_SINK = r"\beval\s*\(|\bexec(Sync|File|FileSync)?\s*\(|\bspawn(Sync)?\s*\(|runInNewContext|new\s+Function\s*\("
_NETWORK = r"\b(fetch|axios|got|request)\s*\(|new\s+(XMLHttpRequest|WebSocket)|\b(https?|net|tls)\.(get|request|connect)\s*\(|\baxios\.\w+\s*\("
_DNS_TXT = r"\bresolve(Txt|Any)\s*\(|\bresolve\s*\([^)]*['\"](TXT|ANY)['\"]"


def surface_band(path: Column) -> Column:
    """The band of the first rule that a path matches; null for other paths."""
    return F.coalesce(*[F.when(path.rlike(p), F.lit(b)) for b, p in SURFACES])


def encoded_arrays(content: Column) -> Column:
    """How many array literals hold eight strings or more, four fifths of them hex or dense base64."""
    # Possessive: a repeated group that may give back takes stack for every string of an array.
    arrays = F.regexp_extract_all(content, F.lit(r"\[\s*+(?:['\"][^'\"\n]*+['\"]\s*+,\s*+){7,}+(?:['\"][^'\"\n]*+['\"]\s*+)?+\]"), F.lit(0))
    strings = lambda a: F.regexp_extract_all(a, F.lit(r"['\"]([^'\"\n]*)['\"]"), F.lit(1))
    encoded = lambda s: s.rlike(r"^(?:[0-9a-fA-F]{2}){3,}+$") | (s.rlike(r"^[A-Za-z0-9+/]{16,}={0,2}$") & (T.entropy_of_short(s) >= 4.5))
    # Where hex strings are enough by themselves, which a count on the text tells, no string is looked at alone.
    total = lambda a: F.regexp_count(a, F.lit(r"['\"][^'\"\n]*+['\"]"))
    plain = lambda a: F.regexp_count(a, F.lit(r"['\"](?:[0-9a-fA-F]{2}){3,}+['\"]"))
    return F.size(F.filter(arrays, lambda a: (total(a) >= 8) & ((plain(a) >= total(a) * 0.8) | (F.size(F.filter(strings(a), encoded)) >= total(a) * 0.8))))


def dense_literals(content: Column) -> Column:
    literals = F.regexp_extract_all(content, F.lit(r"['\"`]([^'\"`\n]{64,})['\"`]"), F.lit(1))
    return F.size(F.filter(literals, lambda s: T.entropy_of_short(s) > 5.0))


def _rolled(per_file: DataFrame, weights: dict[str, int], anchors: list[str], least: int, flag: int, name: str, approx: bool = True) -> DataFrame:
    """Signals once per package; nothing without an anchor; the clamped sum from `least` on."""
    have = [s for s in weights if s in per_file.columns]
    g = per_file.groupBy("package").agg(*[F.max(F.coalesce(s, F.lit(False))).alias(s) for s in have])
    raw = reduce(lambda a, b: a + b, [F.col(s).cast("int") * weights[s] for s in have])
    score = F.least(raw, F.lit(100))
    anchored = reduce(lambda a, b: a | b, [F.col(a) for a in anchors])
    fired = F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in have]))
    out = g.where(anchored).select("package", F.lit(name).alias("detector"), score.alias("score"), fired.alias("signals"), F.lit(approx).alias("approx"))
    return out.where(F.col("score") >= least).withColumn("severity", S.ladder(F.col("score"), [(flag, "critical"), (least, "high")], "medium"))


def code(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(r"\.(js|mjs|cjs)$"))


def dropper(files: DataFrame, packages: DataFrame, dns_tools: list[str] = ()) -> DataFrame:
    """files (package, path, content), packages (package, scripts): encoded arrays with decoders, DNS text records as
    a channel, fingerprints next to network calls, and a README that asks to load the package."""
    c = F.col("content")
    f = code(files).where(c.rlike(_MARKER))
    txt, fingerprint, network = c.rlike(_DNS_TXT), c.rlike(r"process\.(platform|arch)\b|\bos\.(platform|arch|type|release)\s*\("), c.rlike(_NETWORK)
    arrays = encoded_arrays(c) > 0
    facts = f.select(
        "package", (txt & c.rlike(_DECODER) & c.rlike(_SINK)).alias("dns_payload_assembly"), arrays.alias("encoded_string_array"),
        (txt & ~F.col("package").isin(list(dns_tools))).alias("dns_txt_oob"), (arrays & c.rlike(_DECODER)).alias("string_array_decoder"),
        (fingerprint & (network | txt)).alias("fingerprint_network_coupling"), (~T.is_minified(c) & (dense_literals(c) >= 3)).alias("high_entropy_literals"),
        c.rlike(PAAS).alias("paas_stage_resolution"), fingerprint.alias("env_fingerprint"), F.lit(False).alias("readme_directed_entry"),
    )
    hooks = F.size(F.filter(F.map_keys(F.coalesce("scripts", F.create_map().cast("map<string,string>"))), lambda k: k.rlike("^(pre|post)?install$"))) > 0
    readme = files.where(F.col("path").rlike(r"(?i)(^|/)readme(\.\w+)?$")).join(packages.where(~hooks).select("package"), "package")
    shown = F.expr(r"content RLIKE concat('(require\\s*\\(|from|import)\\s*[\'\"]', regexp_replace(package, '([.@/+*?-])', '\\\\$1'), '[\'\"]')")
    entry = readme.where(shown).select("package", F.lit(True).alias("readme_directed_entry"))
    return _rolled(facts.unionByName(entry, allowMissingColumns=True), DROPPER, DROPPER_ANCHORS, 55, 80, "D28-AI-SLOP-DROPPER")


#: Marks of statements, whose tokens are parted by spaces.
FLOW_MARKS = {
    "array": r"\[ (?:['\"][^'\"\n]*+['\"] ?,? ?){8,}+\]", "decoder": r"Buffer \. from \([^)]*, ['\"](hex|base64)['\"] \)|fromCharCode|\batob \(|\bunescape \(|decodeURIComponent \(|parseInt \([^)]*, 16 \)",
    "sink": r"\beval \(|\bexec(Sync|File|FileSync)? \(|\bspawn(Sync)? \(|runInNewContext|\bnew Function \(", "txt": r"\bresolve(Txt|Any) \(|\bresolve \([^)]*['\"](TXT|ANY)['\"]",
    "network": r"\b(fetch|axios|got|request) \(|\bnew (XMLHttpRequest|WebSocket)|\b(https?|net|tls) \. (get|request|connect) \(|\baxios \. \w+ \(",
    "fingerprint": r"process \. (platform|arch)\b|\bos \. (platform|arch|type|release) \(",
}


def dropper_flows(files: DataFrame, dns_tools: list[str] = ()) -> DataFrame:
    """The dropper's signals where the value does reach the call: a decoder that gets an encoded array, execution that gets
    decoded DNS text, a request that gets a fingerprint. files: package, id (of the file), path, content."""
    f = code(files).where(F.col("content").rlike(_MARKER))
    s = reaches(f, FLOW_MARKS, "id")
    has = lambda m: F.array_contains("marks", m)
    gets = lambda m: F.array_contains("reached", m)
    encoded = encoded_arrays(F.regexp_replace("text", "^.*?= ", "")) > 0
    facts = s.select(
        "id", (has("sink") & gets("txt") & gets("decoder")).alias("dns_payload_assembly"), (has("array") & encoded).alias("encoded_string_array"), has("txt").alias("dns_txt_oob"),
        (has("decoder") & gets("array")).alias("string_array_decoder"), (has("network") & gets("fingerprint")).alias("fingerprint_network_coupling"), has("fingerprint").alias("env_fingerprint"),
    ).join(f.select("id", "package"), "id").drop("id")
    facts = facts.withColumn("dns_txt_oob", F.col("dns_txt_oob") & ~F.col("package").isin(list(dns_tools)))
    return _rolled(facts, DROPPER, DROPPER_ANCHORS, 55, 80, "D28-AI-SLOP-DROPPER", approx=False)


def runtime_evasion(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Other runtimes fetched, started or used for execution, by where the code runs: install hook, entry or module.

    packages: package, scripts (map), main. A file a hook names by its base name runs at install time."""
    hook = packages.select("package", F.explode(F.map_entries("scripts")).alias("s")).where(F.col("s.key").rlike("^(pre|post)?install$")).select("package", F.col("s.value").alias("body"))
    named = hook.select("package", F.explode(F.regexp_extract_all("body", F.lit(r"([\w.-]+\.(?:js|mjs|cjs|ts|sh))"), F.lit(1))).alias("base")).distinct().withColumn("install", F.lit(True))
    f = files.withColumn("base", F.element_at(F.split("path", "/"), -1)).join(named, ["package", "base"], "left")
    f = f.join(packages.select("package", F.coalesce("main", F.lit("index.js")).alias("main")), "package", "left")
    c = F.col("content")
    install, entry = F.coalesce("install", F.lit(False)), F.col("path").eqNullSafe(F.regexp_replace("main", r"^\./", ""))
    download = reduce(lambda a, b: a | b, [c.rlike(p) for p in RUNTIME_DOWNLOADS])
    runs = c.rlike(r"\bBun\.(spawn|spawnSync|\$)\s*[(`]|\bDeno\.(run|Command)\b|\bstd\.popen\s*\(|\bos\.exec\s*\(")
    network = c.rlike(r"\bBun\.(connect|fetch)\s*\(|\bDeno\.(connect|connectTls)\s*\(")
    facts = f.where(download | c.rlike(r"\b(Bun|Deno)\b|\bstd\.|\bos\.exec|bun:ffi")).select(
        "package", (download & install).alias("runtime_download_install_time"), download.alias("runtime_download"), c.rlike(r"bun:ffi|\bDeno\.dlopen\s*\(").alias("alt_runtime_ffi"),
        (runs & (install | entry)).alias("alt_runtime_exec_entry"), runs.alias("alt_runtime_exec"), (network & (install | entry)).alias("alt_runtime_network_entry"), network.alias("alt_runtime_network"),
        (c.rlike(r"\b(Bun\.env|Deno\.env)\b.{0,60}(TOKEN|SECRET|KEY|PASSWORD)") | c.rlike(r"\b(Bun\.file|Deno\.readTextFile(Sync)?)\s*\([^)]{0,20}(\.npmrc|\.ssh|\.aws)")).alias("alt_runtime_credential_access"),
        c.rlike(r"\b(Bun\.env|Deno\.env)\b").alias("alt_runtime_env_read"), c.rlike(r"\b(Bun|Deno)\.(serve|listen)\s*\(").alias("alt_runtime_listen"),
        c.rlike(r"\bBun\.file\s*\(|\bDeno\.read\w*\s*\(").alias("alt_runtime_fs_read"), c.rlike(r"typeof\s+(Bun|Deno)\b").alias("runtime_fingerprint"), F.lit(False).alias("alt_runtime_hook_interpreter"),
    )
    b = F.col("body")
    fetched = reduce(lambda x, y: x | y, [b.rlike(p) for p in RUNTIME_DOWNLOADS])
    hooks = hook.select("package", fetched.alias("runtime_download_install_time"), b.rlike(r"^\s*(bun|deno|qjs)\s").alias("alt_runtime_hook_interpreter"))
    return _rolled(facts.unionByName(hooks, allowMissingColumns=True), RUNTIME, RUNTIME_ANCHORS, 55, 80, "D29-RUNTIME-EVASION")


def workspace_persistence(files: DataFrame) -> DataFrame:
    """Files that write to, or are, configuration of editors and agents; each kind and band once."""
    c = F.col("content")
    quoted = r"\bwriteFile(?:Sync)?\s*\(\s*['\"`]([^'\"`]+)['\"`]"
    static = code(files).select("package", F.explode(F.regexp_extract_all(c, F.lit(quoted), F.lit(1))).alias("target"), F.lit("static_surface_write").alias("kind"))
    # Joined paths: the quoted parts between the brackets, put together in order.
    calls = F.regexp_extract_all(c, F.lit(r"\bwriteFile(?:Sync)?\s*\(\s*(?:path\.(?:join|resolve)\s*\(|\[)([^)\]]*)[)\]]"), F.lit(1))
    parts = lambda a: F.array_join(F.regexp_extract_all(a, F.lit(r"['\"`]([^'\"`]+)['\"`]"), F.lit(1)), "/")
    dynamic = code(files).select("package", F.explode(F.transform(calls, parts)).alias("target"), F.lit("dynamic_surface_write").alias("kind"))
    shipped = files.where(surface_band(F.col("path")) == "exec")
    runs = c.rlike(r"\"command\"\s*:|\"hooks\"\s*:|folderOpen|postCreateCommand|run:")
    privileged = F.col("path").rlike(r"(?i)\.github/workflows/") & c.rlike("pull_request_target|workflow_run")
    shipped = shipped.where(runs | privileged).select("package", F.col("path").alias("target"), F.when(privileged, "shipped_workflow_privileged_trigger").otherwise("shipped_exec_config").alias("kind"))
    hits = static.unionByName(dynamic).unionByName(shipped).withColumn("band", surface_band(F.col("target"))).where("band IS NOT NULL")
    once = hits.select("package", "kind", "band").distinct()
    weight = S.lookup(F.col("kind"), WRITE_WEIGHT, 0) + S.lookup(F.col("band"), BAND_WEIGHT, 0)
    g = once.groupBy("package").agg(F.least(F.lit(100), F.sum(weight)).cast("int").alias("score"), F.array_sort(F.collect_list(F.concat_ws(":", "kind", "band"))).alias("signals"))
    return g.withColumn("severity", S.ladder(F.col("score"), [(80, "critical"), (45, "high")], "medium")).withColumn("approx", F.lit(True))


def function_bodies(files: DataFrame) -> DataFrame:
    """Named functions by their heads, each body up to the next head: package, version, name, body."""
    heads = r"(?:function\s+|(?:const|let|var)\s+|\b)([A-Za-z_$][\w$]*)\s*(?:=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>)|\([^)]*\)\s*\{)"
    pieces = F.regexp_extract_all("content", F.lit(rf"(?s){heads}(?:(?!\bfunction\s+[A-Za-z_$]).)*+"), F.lit(0))
    return code(files).select("package", "version", F.explode(pieces).alias("body")).withColumn("name", F.regexp_extract("body", heads, 1))


def crypto_tamper(files: DataFrame, order: DataFrame, names: list[str]) -> DataFrame:
    """Crypto functions that call the network or run code where the version before did not.

    files: package, version, path, content; order: package, version, previous."""
    bodies = function_bodies(files).where(F.col("name").isin(names))
    b = bodies.groupBy("package", "version", "name").agg(F.max(F.col("body").rlike(_NETWORK)).alias("net"), F.max(F.col("body").rlike(_SINK)).alias("dynamic"))
    old = b.select("package", F.col("version").alias("previous"), "name", F.col("net").alias("old_net"), F.col("dynamic").alias("old_dynamic"))
    j = b.join(order, ["package", "version"]).join(old, ["package", "previous", "name"])
    return j.where((F.col("net") & ~F.col("old_net")) | (F.col("dynamic") & ~F.col("old_dynamic"))).select("package", "version", "name", F.lit(85).alias("score"), F.lit("high").alias("severity"))
