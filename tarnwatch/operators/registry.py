"""Rules over registry data: look-alike scores, dependencies, attestations, extensions and model hubs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwatch.functions import severity as S
from tarnwatch.functions import text as T
from tarnwatch.functions.known import REPUTABLE
from tarnwatch.operators import similarity as M
from tarnwatch.operators.iocs import sized
from tarnwatch.operators.windows import micros


def reputable(spark: SparkSession) -> DataFrame:
    """The names that detectors leave alone, as their table."""
    return spark.createDataFrame([(n,) for n in REPUTABLE], "name string")


def typosquat(packages: DataFrame, targets: DataFrame, reputable: DataFrame) -> DataFrame:
    """packages (name, age_days, weekly_downloads: null where unknown): the best target by edits or look-alike
    characters, and scopes around a target's name; age and downloads change the score; 50 to 100.

    Reputable names are left out, also as the part after a scope. Joins broadcast counted lists at most, and no packages."""
    p = packages.withColumn("part", F.regexp_replace("name", "^@[^/]+/", ""))
    known = sized(reputable.select(F.col("name").alias("__r")).distinct())
    p = p.join(known, F.col("name") == F.col("__r"), "left_anti").join(known, F.col("part") == F.col("__r"), "left_anti")
    plain = p.where("name NOT LIKE '@%'")
    names = plain.select("name")
    near = M.near_names(names, targets).select("name", "target", F.when(F.col("distance") == 1, 75).otherwise(45).alias("base"), "ordinal")
    glyph = M.homoglyphs(names.distinct(), targets).hint("merge").join(sized(targets), "target").select("name", "target", F.lit(60).alias("base"), "ordinal")
    scoped = p.where("name LIKE '@%'").hint("merge").join(sized(targets), F.col("part") == F.col("target")).select("name", "target", F.lit(80).alias("base"), "ordinal")
    best = near.unionByName(glyph).unionByName(scoped).groupBy("name").agg(F.max(F.struct("base", (-F.col("ordinal")).alias("o"), "target")).alias("b")).select("name", "b.target", "b.base")
    j = best.hint("merge").join(packages, "name")
    young, few = F.col("age_days") < 30, F.col("weekly_downloads") < 1000
    settled = (F.col("age_days") >= 365) & (F.col("weekly_downloads") >= 100_000)
    on = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    score = F.col("base") + on(young, 15) + on(few, 10) - on(settled, 30)
    return j.select("name", "target", F.least(F.lit(100), F.greatest(F.lit(50), score)).alias("score"))


def transitive(deps: DataFrame, targets: DataFrame, suspicious: str) -> DataFrame:
    """deps (package, dependency, spec): name pattern 55, look-alike 50, major of 99 or more 55; the worst dependency
    plus up to 15 for further ones; 50 and over."""
    alike = M.near_names(deps.select(F.col("dependency").alias("name")), targets).select(F.col("name").alias("dependency")).distinct().withColumn("alike", F.lit(True))
    major = F.regexp_extract("spec", r"^[~^]?(\d+)", 1).try_cast("long")
    d = deps.join(alike, "dependency", "left")
    weight = F.when(F.col("dependency").rlike(suspicious), 55).otherwise(0) + F.when(F.col("alike"), 50).otherwise(0) + F.when(major >= 99, 55).otherwise(0)
    g = d.withColumn("w", weight).where("w > 0").groupBy("package").agg(F.max("w").alias("top"), F.count("*").alias("n"))
    return g.select("package", F.least(F.lit(100), F.col("top") + F.least(F.lit(15), (F.col("n") - 1) * 5)).cast("int").alias("score")).where("score >= 50")


def attestation(versions: DataFrame) -> DataFrame:
    """versions (package, version, integrity, payload: the DSSE payload in base64, null without one, repository):
    the statement's subject and digest against the package, its source against the repository."""
    statement = "subject array<struct<name:string,digest:map<string,string>>>, predicate struct<buildDefinition:struct<externalParameters:struct<workflow:struct<repository:string>>>>"
    s = F.from_json(F.try_to_binary("payload", F.lit("base64")).cast("string"), statement)
    v = versions.withColumn("s", s)
    purl = F.concat(F.lit("pkg:npm/"), F.replace("package", F.lit("@"), F.lit("%40")), F.lit("@"), F.col("version"))
    hexed = F.lower(F.hex(F.try_to_binary(F.split_part("integrity", F.lit("-"), F.lit(2)), F.lit("base64"))))
    named = F.exists("s.subject", lambda x: x["name"] == purl)
    bound = F.exists("s.subject", lambda x: (x["name"] == purl) & F.exists(F.map_values(x["digest"]), lambda d: F.lower(d) == hexed))
    source = T.repo_url(F.col("s.predicate.buildDefinition.externalParameters.workflow.repository"))
    kind = (
        F.when(F.col("payload").isNull(), "none").when(F.col("s").isNull() | F.col("s.subject").isNull(), "malformed").when(~named, "subject_mismatch")
        .when(~bound, "digest_unbound").when(source != T.repo_url(F.col("repository")), "repo_mismatch").otherwise("present")
    )
    score = F.when(kind == "subject_mismatch", 85).when(kind == "digest_unbound", 80).when(kind == "repo_mismatch", 60).when(kind == "malformed", 25).when(kind == "none", 15).otherwise(10)
    return v.select("package", "version", kind.alias("kind"), score.alias("score"))


def blocklisted(packages: DataFrame, blocked: DataFrame) -> DataFrame:
    """Names and versions on a list."""
    return packages.join(sized(blocked.select("package", "version").distinct()), ["package", "version"], "left_semi")


def sibling_overlap(bursts: DataFrame) -> DataFrame:
    """bursts (package, from, until) of packages of one scope that overlap: the latest start before the earliest end."""
    b = bursts.withColumn("scope", F.regexp_extract("package", "^(@[^/]+)/", 1)).where("scope <> ''")
    g = b.groupBy("scope").agg(F.max("from").alias("from"), F.min("until").alias("until"), F.countDistinct("package").alias("packages"))
    return g.where((F.col("packages") >= 2) & (F.col("from") < F.col("until")))


def merge_registries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Extension versions of two registries, each once with the registries that have it."""
    return a.unionByName(b).groupBy("extension", "version").agg(F.array_sort(F.collect_set("registry")).alias("registries"), F.min("published_at").alias("published_at"), F.max("asset_size").alias("asset_size"))


# What activation events weigh, and words of commands and events that go with execution.
ACTIVATION = {"*": "critical", "onStartupFinished": "high", "workspaceContains:**/*": "high", "workspaceContains": "high", "onCommand:*": "low"}
COMMAND_WORDS = ["npx", "bun", "curl", "wget", "exec", "spawn", "execSync"]
EVENT_WORDS = ["npx", "bun", "curl", "wget", "fetch(", "exec(", "spawn(", "execsync", "spawnsync", "child_process", "shell: true", "detached: true"]
SIZE_JUMP = 400 * 1024


def activation_severity(event: Column) -> Column:
    """Five events have a weight of their own, others with a star are high, the rest no risk (null)."""
    return S.lookup(event, ACTIVATION, F.when(event.contains("*"), "high"))


def extension_changes(versions: DataFrame) -> DataFrame:
    """Per version what it activates on that no earlier one did, and whether sizes so far spread by more than a jump.

    An event is new in the version it is first seen in: one window over (extension, event), not over all sets before."""
    key = ["extension", "published_at", "version"]
    upto = Window.partitionBy("extension").orderBy("published_at", "version").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    v = versions.withColumns({"no": F.row_number().over(upto), "size_delta": F.max("asset_size").over(upto) - F.min("asset_size").over(upto) > SIZE_JUMP})
    v = v.withColumn("prior", F.sum(F.size(F.coalesce("activation_events", F.array()))).over(upto.rowsBetween(Window.unboundedPreceding, -1)))
    first = Window.partitionBy("extension", "event").orderBy("published_at", "version")
    events = v.select(*key, F.explode(F.array_distinct("activation_events")).alias("event")).withColumn("seen", F.row_number().over(first)).where("seen = 1")
    new = events.groupBy(*key).agg(F.array_sort(F.collect_list("event")).alias("fresh"))
    got = F.when((F.col("no") > 1), F.coalesce("fresh", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return v.join(new, key, "left").select("extension", "version", got.alias("new_events"), F.coalesce("size_delta", F.lit(False)).alias("size_delta"), (F.coalesce("prior", F.lit(0)) > 0).alias("had_events"))


def activation_risk(versions: DataFrame) -> DataFrame:
    """versions (extension, version, published_at, asset_size, activation_events, titles, bundled) to the risk of each:
    extension, version, risk, why. The worst event counts; words of execution, a jump in size, or a first event beside a
    high one make it critical. Versions without a weighty event have no row."""
    worst = F.array_max(F.transform(F.coalesce("activation_events", F.array().cast("array<string>")), lambda e: S.rank(activation_severity(e))))
    said = lambda c, words: reduce(lambda a, b: a | b, [F.lower(F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")).contains(w) for w in words])
    words = said(F.col("titles"), COMMAND_WORDS) | said(F.col("activation_events"), EVENT_WORDS) | F.array_join(F.coalesce("bundled", F.array().cast("array<string>")), " ").rlike("bun|runtime")
    v = versions.join(extension_changes(versions), ["extension", "version"]).withColumns({"worst": worst, "words": words}).where(F.col("worst") > 0)
    fresh = F.col("had_events") & (F.size("new_events") > 0)
    up = F.col("words") | F.col("size_delta") | (fresh & (F.col("worst") >= S.RANK["high"]))
    why = F.array_compact(F.array(F.when(F.col("words"), "execution_words"), F.when(F.col("size_delta"), "size_jump"), F.when(fresh, "first_event")))
    return v.select("extension", "version", F.when(up, "critical").otherwise(S.from_rank(F.col("worst"))).alias("risk"), F.array_join(why, ",").alias("why"))


def quick_handover(versions: DataFrame, key: str, ts: str, publisher: str, within: int) -> DataFrame:
    """Neighbouring versions of different publishers within minutes."""
    order = Window.partitionBy(key).orderBy("__t", publisher)
    v = versions.withColumn("__t", micros(ts)).withColumns({"before": F.lag(publisher).over(order), "gap": F.col("__t") - F.lag("__t").over(order)})
    return v.where((F.col("before") != F.col(publisher)) & (F.col("gap") <= within)).select(key, F.col(ts).alias("at"), "before", F.col(publisher).alias("after"))


# Four ways in which scripts and code name a repository of a model hub.
HUB_URL = r"(?:huggingface\.co|hf\.co)/([^/\s\"'>]+/[^/\s\"'>]+)"
HUB_PRETRAINED = r"from_pretrained\(\s*[\"']([^\"']+/[^\"']+)[\"']"
HUB_ONE, HUB_TWO = r"hub\.download\(\s*[\"']([^\"']+/[^\"']+)[\"']", r"hub\.download\(\s*[\"']([^\"']+[\"']\s*,\s*[\"'][^\"']+)[\"']"


def model_references(texts: DataFrame) -> DataFrame:
    """References to repositories of a model hub in scripts and code (package, content): package, org, model. The
    organisation is what stands before the first slash."""
    found = lambda p: F.regexp_extract_all("content", F.lit(p), F.lit(1))
    two = F.transform(found(HUB_TWO), lambda m: F.regexp_replace(m, r"[\"']\s*,\s*[\"']", "/"))
    r = texts.select("package", F.explode(F.concat(found(HUB_URL), found(HUB_PRETRAINED), found(HUB_ONE), two)).alias("r")).distinct()
    return r.select("package", F.split_part("r", F.lit("/"), F.lit(1)).alias("org"), F.substring_index("r", "/", -1).alias("model")).distinct()


def spoofed_orgs(files: DataFrame, known_orgs: DataFrame, least: float = 0.82) -> DataFrame:
    """References to organisations that look like known ones, but are none of them."""
    refs = model_references(files)
    known = sized(known_orgs.select(F.lower("target").alias("__k")).distinct())
    odd = refs.join(known, F.lower("org") == F.col("__k"), "left_anti")
    best = M.jaro_winkler_best(odd.select(F.col("org").alias("name")), known_orgs, least)
    return odd.join(best, F.col("org") == F.col("name")).select("package", "org", "model", "target", "score")


def size_budget(archives: DataFrame, most: int = 500 * 1000 * 1000) -> DataFrame:
    """Archives too large to take in are left out before they are read."""
    return archives.where(F.col("length") <= most)
