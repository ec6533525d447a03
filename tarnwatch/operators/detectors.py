"""Content detectors: weighted signals over the files of a package, and rules over its manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions import severity as S
from tarnwatch.functions import text as T
from tarnwatch.functions.signal_catalog import BUILD_FILES, Detector
from tarnwatch.operators.iocs import sized


# Which files count as code; three detectors read native sources too, one signal reads install scripts
# only, one detector reads script bodies beside the code, and one signal counts three matches at most.
SCRIPTED = r"(?i)\.(js|mjs|cjs|ts)$"
NATIVE = r"(?i)\.(js|mjs|cjs|ts|rs|c|cc|cpp|h|hpp)$"
READS_NATIVE = ("D15-MEMORY-EXTRACTION", "D16-EBPF-ROOTKIT", "D17-PRIVILEGE-ESCALATION")
READS_SCRIPTS = ("D24-BUN-RUNTIME-SWAP",)
INSTALL_ONLY = {("D16-EBPF-ROOTKIT", "bpf_syscall")}
MOST = {("D17-PRIVILEGE-ESCALATION", "exploit_reference"): 3}


def weighted(files: DataFrame, name: str, detector: Detector, key: str = "package", content: str = "content") -> DataFrame:
    """Per package with any signal: detector, score (clamped to 100), severity, signals, raw score. Every file counts."""
    return all_weighted(files, {name: detector}, key=key, content=content)


def all_weighted(
    files: DataFrame, catalog: dict[str, Detector], key: str = "package", content: str = "content", path: str | None = None, scripts: DataFrame | None = None
) -> DataFrame:
    """All detectors of a catalogue in one scan of the contents: what leaves a file is one number per signal type.

    With a path, only code files count, by each detector's own suffixes. scripts (key, hook, body): bodies that some
    detectors read beside the files."""
    text = F.coalesce(F.col(content), F.lit(""))
    if path:
        rows = files.select(key, text.alias("__c"), F.col(path).rlike(SCRIPTED).alias("__s"), F.col(path).rlike(NATIVE).alias("__n"), F.lit(False).alias("__b"), F.lit(False).alias("__i"))
    else:
        rows = files.select(key, text.alias("__c"), F.lit(True).alias("__s"), F.lit(True).alias("__n"), F.lit(False).alias("__b"), F.lit(False).alias("__i"))
    if scripts is not None:
        # The install script is postinstall, or where that is absent or empty, install.
        body = F.coalesce("body", F.lit(""))
        named = scripts.where(F.col("hook").isin("postinstall", "install") & (body != "")).groupBy(key).agg(F.max_by("body", F.col("hook") == "postinstall").alias("__c"))
        rows = rows.unionByName(scripts.select(key, body.alias("__c"), F.lit(False).alias("__s"), F.lit(False).alias("__n"), F.lit(True).alias("__b"), F.lit(False).alias("__i")))
        rows = rows.unionByName(named.select(key, "__c", F.lit(False).alias("__s"), F.lit(False).alias("__n"), F.lit(False).alias("__b"), F.lit(True).alias("__i")))
    c, counts, totals, parts = F.col("__c"), [], [], []
    for d, (name, detector) in enumerate(catalog.items()):
        each, names, raw = detector.mode == "each", [], F.lit(0)
        own = F.col("__n") if name in READS_NATIVE else F.col("__s") | F.col("__b") if name in READS_SCRIPTS else F.col("__s")
        for k, (signal, (weight, patterns)) in enumerate(detector.signals.items()):
            at = f"__{d}_{k}"
            reads = F.col("__i") if (name, signal) in INSTALL_ONLY else own
            if each:
                n = reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit(p)) for p in patterns])
            else:
                n = reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns]).cast("int")
            counts.append(F.when(reads, n).otherwise(0).alias(at))
            total = F.sum(at) if each else F.max(at)
            totals.append((F.least(total, F.lit(MOST[name, signal])) if (name, signal) in MOST else total).cast("long").alias(at))
            names.append(F.when(F.col(at) > 0, F.lit(signal)))
            raw = raw + F.col(at) * weight
        score = F.least(raw, F.lit(100))
        band = F.when(score >= detector.flag, "critical").when(score >= detector.warn, "high").when(score >= 30, "medium").otherwise("low")
        parts.append(F.when(raw > 0, F.struct(
            F.lit(name).alias("detector"), score.cast("int").alias("score"), band.alias("severity"), F.array_compact(F.array(*names)).alias("signals"), raw.cast("int").alias("raw_score"))))
    found = rows.select(key, *counts).groupBy(key).agg(*totals)
    return found.select(key, F.explode(F.array_compact(F.array(*parts))).alias("f")).select(key, "f.*")


# The ids and patterns of suspicious code.
CODE_PATTERNS = {
    "EVAL_USAGE": r"\beval\s*\(", "FUNCTION_CONSTRUCTOR": r"Function\s*\(",
    "STRING_REVERSAL_CHAIN": r"\.split\s*\(\s*['\"]\s*['\"]\s*\)\s*\.reverse\s*\(\s*\)\s*\.join\s*\(", "XOR_CIPHER": r"charCodeAt\s*\([^)]*\)\s*\^\s*\w+",
    "BITWISE_LOOP": r"for\s*\([^;]+;[^;]+\)\s*\{[^}]{20,}\^[^}]*\}", "DYNAMIC_REQUIRE": r"require\s*\(\s*(?:Buffer\.from|atob|decodeURIComponent)",
    "BASE64_LITERAL": r"['\"][A-Za-z0-9+/]{60,}={0,2}['\"]", "OBFUSCATED_STRING": r"(?:\\x[0-9a-fA-F]{2}){8,}+", "UNICODE_ESCAPE": r"(?:\\u[0-9a-fA-F]{4}){8,}+",
}


def code_patterns(content: Column) -> Column:
    """The ids of the patterns a text matches, in the order of the list."""
    return F.array_compact(F.array(*[F.when(content.rlike(p), F.lit(n)) for n, p in CODE_PATTERNS.items()]))


def obfuscation(files: DataFrame, key: str, content: str, least: int = 50, shortest: int = 100, reputable: DataFrame | None = None, name: str = "package") -> DataFrame:
    """Entropy, suspicious code, minified shape and size of each text of `shortest` characters or more; from `least` on.
    Bodies of hooks are scored by the same rule from 40 on, whatever their length. Texts of reputable
    packages (column `name`) are left out."""
    x = unlisted(files, reputable, name).select(key, F.coalesce(F.col(content), F.lit("")).alias("c")).where(F.length("c") >= shortest)
    x = x.withColumns({"e": F.round(T.entropy(F.col("c")), 2), "m": T.is_minified(F.col("c")), "p": code_patterns(F.col("c"))})
    n = F.size("p")
    score = (
        F.when(F.col("e") > 5.3, 35).otherwise(0) + F.when(F.col("e") > 5.8, 15).otherwise(0)
        + F.when(n >= 3, 30).when(n >= 1, 20).otherwise(0) + F.when(F.col("m"), 10).otherwise(0) + F.when(F.length("c") > 100_000, 15).otherwise(0)
        + F.when(F.array_contains("p", "XOR_CIPHER") & (n >= 2), 10).otherwise(0) + F.when(F.array_contains("p", "EVAL_USAGE") & (F.col("e") > 5.0), 15).otherwise(0)
    )
    return x.select(key, F.least(score, F.lit(100)).alias("score"), F.array_join("p", ",").alias("patterns")).where(F.col("score") >= least)


def hooks_of(packages: DataFrame, which: str) -> DataFrame:
    """packages (package, scripts map) to one row per script whose name matches: package, hook, body."""
    hooks = packages.select("package", F.explode(F.map_entries("scripts")).alias("s")).select("package", "s.key", "s.value")
    return hooks.where(F.col("key").rlike(which) & (F.col("value") != "")).select("package", F.col("key").alias("hook"), F.col("value").alias("body"))


# The hooks each rule reads.
INSTALL_HOOKS = r"^(install|prepare|pre.*|post.*)$"
FETCHING_HOOKS = r"^(preinstall|install|postinstall|prepare)$"


def lifecycle_hooks(packages: DataFrame) -> DataFrame:
    """One row per hook that runs around an installation: install, prepare, and all that begin with pre or post."""
    return hooks_of(packages, INSTALL_HOOKS)


def unlisted(packages: DataFrame, reputable: DataFrame | None, name: str = "package") -> DataFrame:
    """packages that are not of a list of reputable names."""
    if reputable is None:
        return packages
    known = sized(reputable.select(F.col("name").alias("__r")).distinct())
    return packages.join(known, F.col(name) == F.col("__r"), "left_anti")


def lifecycle_rule(packages: DataFrame, reputable: DataFrame | None = None) -> DataFrame:
    """Hooks scored by what they run: eval or obfuscation with network 90, addresses 70 (internal 90), credentials from
    the environment 90; a hook that loads nothing and reaches 70 counts 2.5 times, to 100 at most. Reputable packages
    are left out. Bodies are read whole, whatever their length."""
    h = lifecycle_hooks(unlisted(packages, reputable))
    b = F.col("body")
    # The signs in a hook's body.
    h = h.select(
        "package", "hook", b.rlike(r"\beval\s*\(|\bFunction\s*\(|\(0,\s*eval\)\s*\(").alias("runs"), T.is_obfuscated(b).alias("hidden"),
        (b.rlike(r"(?i)\b(?:curl|wget|powershell|bash|sh)\b") | b.rlike(r"\b(?:exec|execSync|spawn|spawnSync|fork)\s*\(")).alias("net"),
        (b.rlike(r"(?i)https?://[^'\"\s)\]]+") | b.rlike(r"\b(?:\d{1,3}\.){3}\d{1,3}\b")).alias("address"), b.rlike(r"(?i)github-ent|jira\.internal|docs\.internal").alias("internal"),
        b.rlike(r"process\.env\.(?:AWS_[A-Z_]+|NPM_TOKEN|NPM_AUTH_TOKEN|GIT_TOKEN|SSH_KEY)").alias("env"), (~b.rlike(r"\brequire\s*\(")).alias("silent"),
    )
    base = F.greatest(
        F.when(F.col("runs") | (F.col("hidden") & F.col("net")), 90).otherwise(0),
        F.when(F.col("address") & F.col("internal"), 90).when(F.col("address"), 70).otherwise(0),
        F.when(F.col("env"), 90).otherwise(0),
    )
    h = h.withColumn("base", base).where("base > 0")
    score = F.when(F.col("silent"), F.least(F.col("base") * 2.5, F.lit(100.0))).otherwise(F.col("base").cast("double"))
    return h.select("package", "hook", score.cast("int").alias("score"), F.when(F.col("base") >= 90, "critical").otherwise("high").alias("severity"))


def multistage(packages: DataFrame) -> DataFrame:
    """Hooks that fetch and then execute (82), that leave a detached process (78), or both (95)."""
    h = hooks_of(packages, FETCHING_HOOKS)
    # Calls that fetch, that execute and that detach.
    fetch = F.col("body").rlike(r"\b(?:fetch|axios\.get|axios\.post|http\.get|https\.get)\(|\b(?:curl|wget)\s") & F.col("body").rlike(r"\b(?:execFile|execFileSync|execSync|exec|spawnSync|spawn)\s*\(")
    detached = F.col("body").rlike(r"detached\s*:\s*true")
    score = F.when(fetch & detached, 95).when(fetch, 82).when(detached, 78)
    return h.withColumn("score", score).where("score IS NOT NULL")


def version_confusion(versions: DataFrame, reputable: DataFrame | None = None) -> DataFrame:
    """Versions made to win: 99.99.99 (85), its family (65), or high in all three parts (62). Reputable packages are left
    out."""
    versions = unlisted(versions, reputable)
    v = F.col("version")
    ma, mi, pa = (T.semver_part(v, i) for i in (1, 2, 3))
    # The family.
    score = F.when(v == "99.99.99", 85).when(v.isin("9.9.9", "9.9.10", "10.10.10", "11.11.11"), 65).when((ma >= 9) & (mi >= 5) & (pa >= 5), 62)
    return versions.withColumn("score", score).where("score IS NOT NULL")


def metadata_spoof(packages: DataFrame, reputable: DataFrame | None = None) -> DataFrame:
    """packages (package, urls array, inflated boolean): internal addresses 65, more than one 20 on top, times 1.3
    with an inflated version; inflation alone counts 40 and so shows as 50; never below 50 or above 90."""
    named = lambda u: F.coalesce(F.nullif(T.host(u), F.lit("")), F.nullif(F.regexp_extract(u, r"^(?:[a-z+]+://)?(?:[^@/]*@)?([^/\s:]+)", 1), F.lit("")), F.lit(""))
    n = F.size(F.filter("urls", lambda u: T.is_internal_host(named(u))))
    base = F.lit(65) + F.when(n > 1, 20).otherwise(0)
    inflated = F.coalesce("inflated", F.lit(False))
    score = F.when(n > 0, F.greatest(F.lit(50), F.least(F.lit(90), F.when(inflated, F.round(base * 1.3)).otherwise(base))).cast("int")).when(inflated, 50)
    return unlisted(packages, reputable).select("package", score.alias("score")).where("score IS NOT NULL")


def platform_stem(path: Column) -> Column:
    """A path without what names a platform at its end."""
    return F.regexp_replace(path, r"[-_.]?(linux|darwin|win32|macos|windows|x64|arm64|ia32)+.*$", "")


def platform_groups(files: DataFrame) -> DataFrame:
    """Base names that a package has for two platforms or more."""
    g = files.groupBy("package", platform_stem(F.col("path")).alias("stem")).agg(F.countDistinct("path").alias("variants"))
    return g.where("variants >= 2")


# Where binaries lie, how they end and what they are called; packages that ship them; what starts them.
BINARY_DIRS = r"(^|/)(bin|native)/"
BINARY_SUFFIXES = r"(?i)\.(exe|dll|so|dylib|wasm|node|o|a)$"
BINARY_NAMES = ["bun", "deno", "go", "rustc", "python", "python3", "ruby", "php"]
BINARY_PACKAGES = ["electron", "puppeteer", "sharp", "esbuild", "node-gyp", "node-pre-gyp", "@mapbox/node-pre-gyp"]
STARTS = r"\b(?:spawn|exec|execSync|spawnSync|fork)\s*\(|fs\.chmod\s*\("
PLATFORM_END = r"(?i)-(?:linux|darwin|macos|win32|windows|win)-(?:x64|x86|arm64|ia32)\.?(?:exe)?$"


def binary_embed(files: DataFrame, manifests: DataFrame, code: DataFrame, reputable: DataFrame | None = None) -> DataFrame:
    """Binaries in packages, each scored 50 to 100: package, path, score, subtype, severity.

    files: package, path, bytes (the first four do); manifests: package, bin_name (a single string), bin (values of a map),
    optional (names of optional dependencies), gyp (boolean); code: package, content. A file counts by its first bytes,
    folder, suffix or name. Of sets of one name for several platforms, one a package counts: that of the first path."""
    slashed = F.replace("path", F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(slashed, "/"), -1)
    f = unlisted(files, reputable).where(~F.col("package").isin(BINARY_PACKAGES)).withColumns({"kind": T.magic(F.col("bytes")), "base": name, "in_dir": slashed.rlike(BINARY_DIRS)})
    known = F.lower(F.regexp_replace("base", r"\.\w+$", "")).isin(BINARY_NAMES)
    f = f.where(F.col("kind").isNotNull() | F.col("in_dir") | F.col("path").rlike(BINARY_SUFFIXES) | known)
    f = f.withColumn("stem", F.element_at(F.split(F.regexp_replace(slashed, PLATFORM_END, ""), "/"), -1))
    sets = f.groupBy("package", "stem").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n >= 2")
    sets = sets.groupBy("package").agg(F.min_by("stem", "first").alias("stem")).withColumn("cross", F.lit(1))
    started = code.where(F.col("content").rlike(STARTS)).select("package").distinct().withColumn("started", F.lit(1))
    j = f.join(manifests, "package", "left").join(sets, ["package", "stem"], "left").join(started, "package", "left")
    no = F.array().cast("array<string>")
    declared = (
        F.coalesce(F.col("bin_name") == F.col("base"), F.lit(False)) | F.exists(F.coalesce("bin", no), lambda v: (v == F.col("base")) | v.endswith(F.concat(F.lit("/"), F.col("base"))))
        | F.array_contains(F.coalesce("optional", no), F.col("base")) | (F.coalesce("gyp", F.lit(False)) & F.col("base").endswith(".node"))
    )
    cross = F.col("cross").isNotNull()
    total = (
        F.when(F.col("kind").isNotNull() & (F.col("kind") != "wasm"), 95).otherwise(60) + F.when(cross, 25).otherwise(0) + F.when(F.col("in_dir"), 15).otherwise(0)
        + F.when(declared, 0).otherwise(50) + F.when(F.col("started").isNotNull(), 25).otherwise(0)
    )
    score = F.greatest(F.lit(50), F.least(F.lit(100), total))
    kind = F.coalesce("kind", F.lit("unknown"))
    subtype = F.when(cross, F.concat(F.lit("cross_platform_"), kind)).when(F.col("kind").isNull(), "magic_byte_unknown").otherwise(F.concat(kind, F.lit("_embedded")))
    return j.select("package", "path", score.alias("score"), subtype.alias("subtype"), S.ladder(score, [(90, "critical"), (70, "high")], "medium").alias("severity"))


def follow_hooks(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Hook to the file it names, and on to the files that one requires: two equi-joins on paths, no third hop."""
    path = F.regexp_extract("body", r"(?:node|sh|bash|python3?)\s+(?:\./)?([\w./-]+)", 1)
    first = lifecycle_hooks(packages).select("package", "hook", path.alias("path")).where("path <> ''")
    one = first.join(files.select("package", "path", "content"), ["package", "path"])
    need = F.explode(F.regexp_extract_all("content", F.lit(r"require\s*\(\s*['\"](?:\./)?([\w./-]+)['\"]"), F.lit(1)))
    two = one.select("package", "hook", F.col("path").alias("first"), need.alias("__r")).distinct()
    two = two.withColumn("path", F.when(F.col("__r").rlike(r"\.\w+$"), F.col("__r")).otherwise(F.concat("__r", F.lit(".js"))))
    two = two.join(files.select("package", "path"), ["package", "path"])
    return one.select("package", "hook", F.array("path").alias("chain")).unionByName(two.select("package", "hook", F.array("first", "path").alias("chain")))


def tarball_desync(tarball: DataFrame, source: DataFrame) -> DataFrame:
    """Files of a package against those of its source tree: absent there, or of other content, with line ends and
    trailing spaces not counted."""
    digest = F.sha2(F.regexp_replace(F.regexp_replace("content", "\r\n?", "\n"), r"(?m)[ \t]+$", ""), 256)
    t = tarball.select("package", "path", digest.alias("own"))
    s = source.select("package", "path", digest.alias("theirs"))
    kind = F.when(F.col("theirs").isNull(), "absent_from_source").when(F.col("own") != F.col("theirs"), "modified")
    return t.join(s, ["package", "path"], "left").withColumn("kind", kind).where("kind IS NOT NULL").select("package", "path", "kind")


def content_size_pairs(files: DataFrame, least: int = 51_200) -> DataFrame:
    """Modules shipped in two forms, .cjs and .mjs, one of them far larger."""
    f = files.where(F.col("path").rlike(r"\.(cjs|mjs)$")).withColumn("stem", F.regexp_replace("path", r"\.(cjs|mjs)$", ""))
    g = f.groupBy("package", "stem").agg(F.max(F.when(F.col("path").endswith(".cjs"), F.col("size"))).alias("cjs"), F.max(F.when(F.col("path").endswith(".mjs"), F.col("size"))).alias("mjs"))
    return g.where(F.abs(F.col("cjs") - F.col("mjs")) > least)


def build_config(files: DataFrame) -> DataFrame:
    """Build files (package, path, content) by their kinds; a gyp file alone counts 20; clamped sum and signals."""
    parts = [weighted(files.where(F.col("path").rlike(p)), "D14", d).select("package", "raw_score", "signals") for p, d in BUILD_FILES.items()]
    gyp = files.where(F.col("path").rlike(r"\.gypi?$")).select("package").distinct().select("package", F.lit(20).alias("raw_score"), F.array(F.lit("gyp_present")).alias("signals"))
    g = reduce(DataFrame.unionByName, [*parts, gyp]).groupBy("package").agg(F.sum("raw_score").alias("raw"), F.flatten(F.collect_list("signals")).alias("signals"))
    score = F.least("raw", F.lit(100)).cast("int")
    return g.select("package", score.alias("score"), F.array_sort("signals").alias("signals"), S.ladder(score, [(99, "critical"), (70, "high"), (30, "medium")]).alias("severity"))


# Addons that are expected to have a build file, packages that are left out, and the weights beside patterns.
NATIVE_ADDONS = ["node-sass", "sqlite3", "bcrypt", "@mapbox/node-pre-gyp", "better-sqlite3", "sharp", "canvas", "node-gyp", "prebuild-install"]
BUILD_REPUTABLE = ["electron", "puppeteer", "playwright", "sharp", "esbuild", "node-gyp", "@mapbox/node-pre-gyp", "node-pre-gyp", "webpack", "vite", "rollup"]
UNEXPECTED, UNDECLARED, SHELL_ROW, LINKER_ROW, LARGE_ADDON, REBUILT = 20, 45, 50, 35, 30, 99
ADDON_BYTES = 10 * 1024 * 1024


def build_abuse(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Build configuration of packages: package, score (clamped sum), severity, signals.

    packages: package, scripts, gypfile (declares a native build); files: package, path, content, size. The first
    binding.gyp of a package counts by its patterns and again by its rows (shell expansions, linker flags); other build
    files and sources by theirs; large addons by size; a build file that the manifest does not declare, more so where it
    is not expected; and a hook that rebuilds from one with a shell or macro in it."""
    from tarnwatch.operators.source_tokens import gyp_rows

    named = F.regexp_replace("path", r"\\\\", "/")
    f = files.where(~F.regexp_extract("package", "^(@[^/]+/[^/]+|[^/]+)", 1).isin(BUILD_REPUTABLE))
    gyp = f.where(named.rlike("(?i)(^|/)binding\\.gyp$")).groupBy("package").agg(F.min_by("content", "path").alias("content"))
    kinds = list(BUILD_FILES.values())
    counted = [weighted(gyp, "D14", kinds[0])]
    counted += [weighted(f.where(F.col("path").rlike(p)), "D14", d) for p, d in ((r"(?i)(\.mk|makefile|cmakelists\.txt|configure|\.cmake)$", kinds[1]), (r"(?i)\.(c|cc|cpp|cxx|h|hpp)$", kinds[2]))]
    parts = [c.select("package", F.col("raw_score").alias("raw"), "signals") for c in counted]
    one = lambda df, n, name: df.select("package", F.lit(n).alias("raw"), F.array(F.lit(name)).alias("signals"))
    rows = gyp_rows(gyp)
    parts += [one(rows.where("kind = 'shell'"), SHELL_ROW, "gyp_shell_exec"), one(rows.where("kind = 'linker'"), LINKER_ROW, "linker_flag")]
    parts.append(one(f.where(F.lower("path").endswith(".node") & (F.col("size") > ADDON_BYTES)), LARGE_ADDON, "large_addon"))
    install = F.coalesce(F.try_element_at("scripts", F.lit("install")), F.lit(""))
    m = packages.select("package", (F.coalesce("gypfile", F.lit(False)) | install.contains("node-gyp") | install.contains("node-pre-gyp")).alias("declared"), F.exists(
        F.array(*[F.coalesce(F.try_element_at("scripts", F.lit(h)), F.lit("")) for h in ("preinstall", "install", "postinstall", "prepare", "prepublish")]), lambda s: s.contains("node-gyp rebuild")).alias("rebuilds"))
    have = gyp.select("package").join(m, "package", "left")
    undeclared = ~F.coalesce("declared", F.lit(False))
    parts.append(one(have.where(undeclared & ~F.col("package").isin(NATIVE_ADDONS)), UNEXPECTED, "gyp_present"))
    parts.append(one(have.where(undeclared & F.col("declared").isNotNull()), UNDECLARED, "undeclared_gyp"))
    g = reduce(DataFrame.unionByName, parts).groupBy("package").agg(F.sum("raw").alias("raw"), F.array_distinct(F.flatten(F.collect_list("signals"))).alias("signals"))
    armed = F.coalesce("rebuilds", F.lit(False)) & (F.arrays_overlap("signals", F.array(*map(F.lit, ["shell_exec", "makefile_shell_exec", "compile_macro_injection", "gyp_shell_exec"]))))
    g = g.join(have.select("package", "rebuilds"), "package", "left").withColumn("armed", armed)
    score = F.least(F.lit(100), F.col("raw") + F.when(F.col("armed"), REBUILT).otherwise(0)).cast("int")
    signals = F.when(F.col("armed"), F.array_append("signals", F.lit("rebuilt_by_hook"))).otherwise(F.col("signals"))
    return g.select("package", score.alias("score"), S.ladder(score, [(70, "critical"), (50, "high"), (30, "medium")]).alias("severity"), F.array_join(F.array_sort(signals), ",").alias("signals"))
