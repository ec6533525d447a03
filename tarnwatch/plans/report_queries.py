"""Similarity, indicators, policy, calibration and report queries over the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwatch.functions import text as T
from tarnwatch.operators import calibration as C
from tarnwatch.operators import iocs as I
from tarnwatch.operators import policy as P
from tarnwatch.operators import reports as R
from tarnwatch.operators import similarity as M
from tarnwatch.plans.standins import WITH, findings, scans
from tarnwatch.sources.tables import table


def _findings(s, d):
    """Findings with what reports and policy ask for."""
    f = findings(s, d)
    return f.withColumns({
        "version": F.concat((F.col("finding_id") % 7).cast("string"), F.lit(".0.0")),
        "description": F.concat_ws(" | ", F.lit("finding, of"), "atk_id", "severity"),
        "detector": F.concat(F.lit("D"), (F.col("finding_id") % 10).cast("string")),
        "campaign": F.concat(F.lit("C"), (F.col("scan_id") % 5).cast("string")),
        "confidence": F.when(F.col("confidence_score") >= 20, F.col("confidence_score").cast("double")),
        "expected": F.col("finding_id") % 3 == 0,
        "is_dist_build": F.col("finding_id") % 2 == 0,
        "is_test_fixture": F.col("finding_id") % 5 == 0,
        "is_lifecycle_hook": F.col("finding_id") % 7 == 0,
        "is_multi_layer": F.col("finding_id") % 11 == 0,
        "file_path": F.concat(F.lit("src/"), (F.col("package") % 4).cast("string"), F.lit("/index.js")),
    })


_F = WITH + """, f AS (SELECT *, CAST(finding_id % 7 AS VARCHAR) || '.0.0' AS version, concat_ws(' | ', 'finding, of', atk_id, severity) AS description,
  'D' || CAST(finding_id % 10 AS VARCHAR) AS detector, 'C' || CAST(scan_id % 5 AS VARCHAR) AS campaign,
  CASE WHEN confidence_score >= 20 THEN CAST(confidence_score AS DOUBLE) END AS confidence, finding_id % 3 = 0 AS expected,
  finding_id % 2 = 0 AS is_dist_build, finding_id % 5 = 0 AS is_test_fixture, finding_id % 7 = 0 AS is_lifecycle_hook, finding_id % 11 = 0 AS is_multi_layer,
  'src/' || CAST(package % 4 AS VARCHAR) || '/index.js' AS file_path FROM findings) """


def _rules(s):
    rows = [("ATK-001", "*", True, None, None), ("ATK-002", "17", None, None, None), ("ATK-003", "*", None, False, T.glob("src/1/*.js"))]
    return s.createDataFrame(rows, "atk_id string, package string, is_dist_build boolean, is_test_fixture boolean, path_regex string")


def _part_names(s, d):
    return table(s, d, "part").select(F.element_at(F.split("p_name", " "), 1).alias("name")).distinct()


def _targets(s, d):
    return table(s, d, "part").select(F.element_at(F.split("p_type", " "), -1).alias("target")).distinct().unionByName(
        table(s, d, "part").select(F.element_at(F.split("p_name", " "), -1).alias("target")).distinct()
    ).distinct().withColumn("ordinal", F.ascii("target") * 100 + F.length("target"))


def _version_diff(s, d):
    """Parts sold in one year and not the year before, by supplier: what is new between two versions."""
    l = table(s, d, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y")).distinct()
    before = l.select("l_suppkey", "l_partkey", (F.col("y") + 1).alias("y"))
    new = l.join(before, ["l_suppkey", "l_partkey", "y"], "left_anti")
    return new.groupBy("l_suppkey", "y").agg(F.count("*").alias("added"))


def _registry_merge(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("version"), F.lit("A").alias("registry"), F.col("c_nationkey").alias("nation"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("version"), F.lit("B").alias("registry"), F.col("s_nationkey").alias("nation"))
    u = a.unionByName(b).groupBy("version").agg(F.concat_ws(",", F.array_sort(F.collect_set("registry"))).alias("registries"), F.min("nation").alias("nation"))
    return u


def _two_hop(s, d):
    """nation -> supplier -> part: what a nation reaches in two steps, each once."""
    n, p, l = table(s, d, "nation"), table(s, d, "supplier"), table(s, d, "lineitem")
    sold = l.select("l_suppkey", "l_partkey").distinct()
    j = sold.join(p, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


def _platforms(s, d):
    """Binaries of one base name under several platform suffixes."""
    from tarnwatch.operators.detectors import platform_groups
    from tarnwatch.plans.package_data import pick

    path = F.concat(F.lit("tool"), (F.col("p_size") % 3).cast("string"), pick(["-linux-x64", "-darwin-arm64", "", "-win32.exe"], "p_size"))
    return platform_groups(table(s, d, "part").select((F.col("p_partkey") % 101).alias("package"), path.alias("path")))


def _scan_arrays(s, d):
    f = _findings(s, d)
    return f.groupBy("scan_id", "campaign").agg(F.collect_set("detector").alias("detected")).withColumn(
        "expected", F.array(F.concat(F.lit("D"), (F.col("scan_id") % 10).cast("string")), F.concat(F.lit("D"), ((F.col("scan_id") + 1) % 10).cast("string")))
    )


def _injection_turns(s, d):
    """Words end where no ASCII word character follows, as in the SQL: Java's own boundary takes letters beyond ASCII and
    marks above letters for parts of words. A capital I with a dot is lowered to i alone, not to i and a mark."""
    rows = table(s, d, "conversations").select("conv_id", "turn", F.lower(F.replace("text", F.lit("\u0130"), F.lit("i"))).alias("low"))
    # What stands before a word is asked behind it, else it would be asked at every character.
    word = lambda *words: F.col("low").rlike(f"({'|'.join(f'{w}(?<![0-9a-z_]{w})' for w in words)})(?![0-9a-z_])")
    score = F.when(F.col("low").rlike("ignore (all|previous) instructions|disregard"), 75).when(word("curl", "wget", "bash", "sudo"), 95).when(word("the", "of"), 10).otherwise(0)
    return rows.select("conv_id", "turn", score.alias("score")).where("score > 0")


def _windows(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    mid = F.timestamp_micros(((F.unix_micros(F.col("lo").cast("timestamp")) + F.unix_micros(F.col("hi").cast("timestamp"))) / 2).cast("long"))
    return e.select("user_id", F.col("lo").cast("timestamp").alias("from"), F.when(F.col("user_id") % 2 == 0, mid).alias("until"))


QUERIES = {
    "entropy_docs": lambda s, d: table(s, d, "documents").select("doc_id", F.round(T.entropy(F.coalesce("text", F.lit(""))), 4).alias("entropy")),
    "minified_docs": lambda s, d: table(s, d, "pages").select("page_id", T.is_minified(F.col("html")).alias("minified")),
    "line_of_match": lambda s, d: table(s, d, "documents").select("doc_id", T.line_of(F.col("text"), "[0-9]{2}").alias("line")),
    "url_host_internal": lambda s, d: table(s, d, "pages").select("page_id", T.host(F.col("url")).alias("host")).withColumn("internal", T.is_internal_host(F.col("host"))),
    "prompt_injection_turns": _injection_turns,
    "typosquat_pairs": lambda s, d: M.near_names(_part_names(s, d), _targets(s, d)).select("name", "target", "distance"),
    "typosquat_best": lambda s, d: M.best_target(M.near_names(_part_names(s, d), _targets(s, d))),
    "homoglyph_pairs": lambda s, d: M.homoglyphs(
        table(s, d, "part").select(F.replace(F.element_at(F.split("p_name", " "), 1), F.lit("o"), F.lit("0")).alias("name")).distinct(), _part_names(s, d).withColumnRenamed("name", "target")
    ),
    "jaro_winkler_best": lambda s, d: M.jaro_winkler_best(table(s, d, "nation").select(F.col("n_name").alias("name")), table(s, d, "region").select(F.col("r_name").alias("target")), 0.5),
    "near_dup_simhash": lambda s, d: M.simhash_neighbours(M.token_simhash(table(s, d, "documents"), "doc_id", "text"), "doc_id"),
    "ioc_contains": lambda s, d: I.contains_any(table(s, d, "documents"), table(s, d, "benchmark").withColumnRenamed("text", "needle"), "doc_id", "text", "item_id", "needle"),
    "ioc_time_range": lambda s, d: I.by_time(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), _windows(s, d), "user_id", "ts").select("event_id", "user_id"),
    "hash_match": lambda s, d: I.by_hash(table(s, d, "documents"), table(s, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).count().where("count > 1"), "text").select("doc_id", "sha256"),
    "suppress_antijoin": lambda s, d: P.suppress(_findings(s, d), _rules(s)).select("finding_id"),
    "severity_override": lambda s, d: P.override(_findings(s, d), s.createDataFrame([("ATK-004", "low"), ("ATK-005", "critical")], "atk_id string, severity string")).select("finding_id", "severity"),
    "fail_on": lambda s, d: P.fails(_findings(s, d), "critical"),
    "hit_rate_guard": lambda s, d: P.hit_rate_guard(_findings(s, d), _findings(s, d).select("package"), 10, 0.15).groupBy("package", "detector").agg(F.count("*").alias("n")),
    "control_map_left": lambda s, d: R.control_table(_findings(s, d).where("severity = 'critical' AND atk_id < 'ATK-007'"), R.nist_controls(s)),
    "stig_table": lambda s, d: R.control_table(_findings(s, d), R.stig_controls(s)),
    "export_cef": lambda s, d: R.cef(_findings(s, d)),
    "export_csv": lambda s, d: R.csv(_findings(s, d)),
    "export_qradar": lambda s, d: R.qradar(_findings(s, d)),
    "export_sentinel": lambda s, d: R.sentinel(_findings(s, d)),
    "export_ecs": lambda s, d: R.ecs(_findings(s, d).join(scans(s, d).select("scan_id", "scanned_at"), "scan_id")),
    "sarif_rules": lambda s, d: R.sarif_rules(_findings(s, d)),
    "report_text": lambda s, d: R.scan_text(_findings(s, d)),
    "report_badges": lambda s, d: R.badges(scans(s, d), _findings(s, d)),
    "report_summary": lambda s, d: R.summary(_findings(s, d)),
    "sbom_components": lambda s, d: R.sbom(_findings(s, d).select("package", "version").distinct(), _findings(s, d)),
    "precision_by_detector": lambda s, d: C.precision_by_detector(_findings(s, d)),
    "detection_matrix": lambda s, d: C.detection_matrix(_findings(s, d)),
    "campaign_rates": lambda s, d: C.campaign_rates(_scan_arrays(s, d)),
    "false_positives": lambda s, d: C.false_positives(_findings(s, d), s.createDataFrame([(1, "D1")], "package long, detector string")),
    "corpus_rates": lambda s, d: C.corpus_rates(table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select((F.col("toxic") == 0).alias("clean"), F.col("text").rlike("idiot|scum|trash").cast("int").alias("findings"))),
    "version_diff": _version_diff,
    "registry_merge": _registry_merge,
    "graph_two_hop": _two_hop,
    "cross_platform_groups": _platforms,
}

_TARGETS = """t AS (SELECT DISTINCT target, CAST(ascii(target) AS INT) * 100 + length(target) AS ordinal FROM (
  SELECT string_split(p_type, ' ')[-1] AS target FROM part UNION SELECT string_split(p_name, ' ')[-1] FROM part)),
n AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS name FROM part),
p AS (SELECT name, target, ordinal, levenshtein(name, target) AS distance FROM n, t WHERE abs(length(name) - length(target)) <= 2 AND levenshtein(name, target) BETWEEN 1 AND 2)"""

_CEFSEV = "CASE severity WHEN 'critical' THEN '10' WHEN 'high' THEN '8' WHEN 'medium' THEN '5' WHEN 'low' THEN '2' ELSE '5' END"
_QID = "CASE severity WHEN 'critical' THEN 90050001 WHEN 'high' THEN 90050002 WHEN 'low' THEN 90050004 ELSE 90050003 END"
_QCAT = "CASE severity WHEN 'critical' THEN 'Critical' WHEN 'high' THEN 'High' WHEN 'low' THEN 'Low' ELSE 'Medium' END || ' Severity Malware'"
_RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
_NIST = ", ".join(f"('{k}', '{c}', '{t}')" for k, (c, t) in R.NIST.items())
_STIG = ", ".join(f"('{a}', '{s}', '{t}')" for s, (a, t) in R.STIG.items())
_EACH = ", ".join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}" for x in ("critical", "high", "medium", "low", "info"))

ORACLE = {
    "entropy_docs": """SELECT doc_id, round(coalesce(-sum(n / total * log2(n / total)), 0), 4) AS entropy FROM (
  SELECT d.doc_id, c.n::DOUBLE AS n, c.total::DOUBLE AS total FROM documents d LEFT JOIN (
    SELECT doc_id, ch, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE length(text) > 0) GROUP BY doc_id, ch) c USING (doc_id))
GROUP BY doc_id""",
    "minified_docs": """WITH x AS (SELECT page_id, html, regexp_extract_all(html, '[A-Za-z_$][A-Za-z0-9_$]*') AS names FROM pages)
SELECT page_id, length(html) >= 100 AND ((len(string_split(html, chr(10))) <= 3 AND length(html) > 1000) OR (len(names) >= 10 AND length(array_to_string(names, '')) < len(names) * 3)) AS minified FROM x""",
    "line_of_match": """SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{2}') THEN CAST(len(string_split(regexp_extract(text, '^((?:[^0-9]|[0-9](?:[^0-9]))*)', 1), chr(10))) AS INT) ELSE 0 END AS line FROM documents""",
    "url_host_internal": r"""SELECT page_id, host, regexp_matches(host, '\.(internal|local|corp|intra|priv|lan)([.:/]|$)|github-ent|jira-ent|github\.enterprise|internal-gitlab|gitlab\.internal|jenkins\.internal|confluence\.internal')
  OR regexp_matches(host, '^(10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2[0-9]|3[01])\.\d+\.\d+)') AS internal
FROM (SELECT page_id, lower(regexp_extract(url, 'https?://([^/:?#\s"''<>]+)', 1)) AS host FROM pages)""",
    "prompt_injection_turns": r"""SELECT * FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'ignore (all|previous) instructions|disregard') THEN 75
  WHEN regexp_matches(lower(text), '\b(curl|wget|bash|sudo)\b') THEN 95 WHEN regexp_matches(lower(text), '\b(the|of)\b') THEN 10 ELSE 0 END AS score FROM conversations) WHERE score > 0""",
    "typosquat_pairs": f"WITH {_TARGETS} SELECT name, target, distance FROM p",
    "typosquat_best": f"WITH {_TARGETS} SELECT name, b.target AS target, b.distance AS distance, CASE WHEN b.distance = 1 THEN 75 ELSE 45 END AS score FROM (SELECT name, min(struct_pack(distance := distance, ordinal := ordinal, target := target)) AS b FROM p GROUP BY name)",
    "homoglyph_pairs": """WITH n AS (SELECT DISTINCT replace(string_split(p_name, ' ')[1], 'o', '0') AS name FROM part), t AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS target FROM part)
SELECT name, target, round(1 - len(list_filter(range(1, length(name) + 1), lambda i: name[i] <> target[i])) / length(name)::DOUBLE, 4) AS score FROM n, t
WHERE translate(name, '01345678@', 'oleasgtba') = translate(target, '01345678@', 'oleasgtba') AND name <> target AND length(name) = length(target)""",
    "ioc_contains": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "ioc_time_range": """WITH w AS (SELECT user_id, min(ts) AS lo, CASE WHEN user_id % 2 = 0 THEN make_timestamp(CAST(floor((epoch_us(min(ts)) + epoch_us(max(ts))) / 2.0) AS BIGINT)) END AS hi FROM events GROUP BY user_id)
SELECT event_id, user_id FROM events JOIN w USING (user_id) WHERE ts >= lo AND (hi IS NULL OR ts <= hi)""",
    "hash_match": "SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)",
    "suppress_antijoin": _F + """SELECT finding_id FROM f WHERE is_lifecycle_hook OR is_multi_layer OR NOT (
  (atk_id = 'ATK-001' AND is_dist_build) OR (atk_id = 'ATK-002' AND package = 17) OR (atk_id = 'ATK-003' AND NOT is_test_fixture AND regexp_matches(file_path, '^src/1/[^/]*\\.js$')))""",
    "severity_override": _F + "SELECT finding_id, CASE atk_id WHEN 'ATK-004' THEN 'low' WHEN 'ATK-005' THEN 'critical' ELSE severity END AS severity FROM f",
    "fail_on": _F + f"SELECT scan_id, max({_RANK}) AS worst_rank, max({_RANK}) >= 5 AS blocked FROM f GROUP BY scan_id",
    "hit_rate_guard": _F + """SELECT package, detector, n FROM (SELECT package, detector, count(*) AS n, sum(count(*)) OVER (PARTITION BY package) AS files FROM f GROUP BY package, detector)
WHERE NOT (files >= 10 AND n > files * 0.15::DOUBLE)""",
    "control_map_left": _F + f"""SELECT m.atk_id, m.control, m.title, count(f.finding_id) AS findings, CASE WHEN count(f.finding_id) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM (VALUES {_NIST}) m(atk_id, control, title) LEFT JOIN f ON f.atk_id = m.atk_id AND f.severity = 'critical' AND f.atk_id < 'ATK-007' GROUP BY ALL""",
    "stig_table": _F + f"""SELECT m.atk_id, m.control, m.title, count(f.finding_id) AS findings, CASE WHEN count(f.finding_id) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM (VALUES {_STIG}) m(atk_id, control, title) LEFT JOIN f ON f.atk_id = m.atk_id GROUP BY ALL""",
    "export_cef": _F + f"""SELECT finding_id, concat_ws('|', 'CEF:0', 'tarnwatch', 'tarnwatch', '0.1.0', atk_id, e, {_CEFSEV}, 'suser=' || package || ' ' || version, 'msg=' || e, 'cs1=' || atk_id, 'cs1Label=atkId',
  'cs2=' || severity, 'cs2Label=severity', 'cs3=' || package, 'cs3Label=package', 'cs4=' || version, 'cs4Label=version') AS line FROM (SELECT *, replace(description, '|', '\\|') AS e FROM f)""",
    "export_csv": _F + "SELECT finding_id, concat_ws(',', package, version, atk_id, severity, replace(description, ',', ';')) AS line FROM f",
    "export_qradar": _F + f"""SELECT finding_id, CAST(to_json(struct_pack(source := 'tarnwatch', devicepayload := concat_ws(chr(9), package, version, atk_id, severity, description), atk_id := atk_id, severity := severity,
  package_name := CAST(package AS VARCHAR), package_version := version, finding_title := description, qid := {_QID}, category := {_QCAT})) AS VARCHAR) AS line FROM f""",
    "export_sentinel": _F + """SELECT finding_id, CAST(to_json(struct_pack(SourceSystem := 'tarnwatch', SeverityLevel := severity, Severity := upper(severity), ATKId := atk_id, FindingTitle := description,
  PackageName := CAST(package AS VARCHAR), PackageVersion := version)) AS VARCHAR) AS line FROM f""",
    "sarif_rules": _F + """SELECT atk_id, arg_min(description, finding_id) AS description, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS error,
  count(*) FILTER (WHERE severity = 'medium') AS warning, count(*) FILTER (WHERE severity IN ('low', 'info')) AS note FROM f GROUP BY atk_id""",
    "report_text": _F + f"SELECT scan_id, arg_max(severity, {_RANK}) AS worst, {_EACH} FROM f GROUP BY scan_id",
    "report_badges": _F + """SELECT count(*) FILTER (WHERE c) AS critical, count(*) FILTER (WHERE h) AS high, count(*) FILTER (WHERE m) AS medium, count(*) FILTER (WHERE l) AS low,
  count(*) FILTER (WHERE c IS NULL) AS clean, count(*) AS scans FROM scans LEFT JOIN (SELECT scan_id, bool_or(severity = 'critical') AS c, bool_or(severity = 'high') AS h, bool_or(severity = 'medium') AS m, bool_or(severity = 'low') AS l FROM f GROUP BY scan_id) USING (scan_id)""",
    "report_summary": _F + f"SELECT {_EACH}, count(DISTINCT package) AS packages FROM f",
    "precision_by_detector": _F + "SELECT detector, count(*) AS hits, count(*) FILTER (WHERE expected) AS expected_hits, round(avg(confidence), 4) AS avg_confidence, round(count(*) FILTER (WHERE expected) / count(*)::DOUBLE, 4) AS precision FROM f GROUP BY detector",
    "detection_matrix": _F + "SELECT campaign, detector, count(*) AS n FROM f GROUP BY campaign, detector",
    "campaign_rates": _F + """, a AS (SELECT scan_id, campaign, len(list_intersect(list_distinct(list(detector)), ['D' || (scan_id % 10), 'D' || ((scan_id + 1) % 10)])) AS m FROM f GROUP BY scan_id, campaign)
SELECT campaign, count(*) AS total, count(*) FILTER (WHERE m > 0) AS hit, CAST(count(*) * 2 AS BIGINT) AS expected, CAST(sum(m) AS BIGINT) AS matched,
  round(count(*) FILTER (WHERE m > 0) / count(*)::DOUBLE, 4) AS detection_rate, round(sum(m) / (count(*) * 2)::DOUBLE, 4) AS match_rate FROM a GROUP BY campaign""",
    "false_positives": _F + """SELECT detector, count(*) AS n, round(avg(confidence), 4) AS avg_confidence, count(DISTINCT package) AS packages, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
  round(count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS share, count(*) >= 5 AS high_fp FROM f WHERE (confidence >= 70 OR confidence IS NULL) AND NOT (package = 1 AND detector = 'D1') GROUP BY detector""",
    "corpus_rates": """SELECT round(avg(CASE WHEN toxic = 0 THEN h END), 4) AS fp_rate, round(avg(CASE WHEN toxic <> 0 THEN h END), 4) AS detection_rate
FROM (SELECT toxic, CAST(regexp_matches(text, 'idiot|scum|trash') AS DOUBLE) AS h FROM documents JOIN labels USING (doc_id))""",
    "version_diff": """WITH l AS (SELECT DISTINCT l_suppkey, l_partkey, year(l_shipdate) AS y FROM lineitem)
SELECT l_suppkey, CAST(y AS INT) AS y, count(*) AS added FROM l WHERE NOT EXISTS (SELECT 1 FROM l p WHERE p.l_suppkey = l.l_suppkey AND p.l_partkey = l.l_partkey AND p.y + 1 = l.y) GROUP BY l_suppkey, y""",
    "registry_merge": """SELECT version, array_to_string(list_sort(list_distinct(list(registry))), ',') AS registries, min(nation) AS nation FROM (
  SELECT c_custkey AS version, 'A' AS registry, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, 'B', s_nationkey FROM supplier) GROUP BY version""",
    "graph_two_hop": """SELECT n_name, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    "cross_platform_groups": """SELECT package, stem, count(DISTINCT path) AS variants FROM (SELECT p_partkey % 101 AS package, 'tool' || CAST(p_size % 3 AS VARCHAR) AS stem, p_size % 3 AS a, p_size % 4 AS path FROM part) GROUP BY package, stem HAVING count(DISTINCT path) >= 2""",
}

_BITS = ", ".join(f"CASE WHEN sum(n * (((h >> {b}) & 1) * 2 - 1)) > 0 THEN {1 << b} ELSE 0 END AS b{b}" for b in range(32))
ORACLE["near_dup_simhash"] = f"""WITH k AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(trim(text)), '\\s+')) AS t FROM documents) WHERE t <> '' GROUP BY doc_id, t),
w AS (SELECT t, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(t, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: (a * 33 + c) & 4294967295) AS h FROM (SELECT DISTINCT t FROM k)),
v AS (SELECT doc_id, {_BITS} FROM k JOIN w USING (t) GROUP BY doc_id), s AS (SELECT doc_id, CAST({' + '.join(f'b{b}' for b in range(32))} AS BIGINT) AS simhash FROM v),
r AS (SELECT simhash, min(doc_id) AS class_id, count(*) AS copies FROM s GROUP BY simhash),
p AS (SELECT x.simhash AS a, y.simhash AS b, x.class_id AS doc_id, y.class_id AS other, x.copies, round(1 - bit_count(xor(x.simhash, y.simhash)) / 32.0::DOUBLE, 4) AS similarity FROM r x JOIN r y ON x.simhash < y.simhash AND bit_count(xor(x.simhash, y.simhash)) <= 3),
n AS (SELECT h, count(*) AS links FROM (SELECT a AS h FROM p UNION ALL SELECT b FROM p) GROUP BY h)
SELECT doc_id, other, similarity, 'pair' AS kind, doc_id AS class_id, copies, CAST(NULL AS BIGINT) AS links FROM p
UNION ALL SELECT s.doc_id, r.class_id, 1.0, 'member', r.class_id, r.copies, coalesce(links, 0) FROM s JOIN r USING (simhash) LEFT JOIN n ON n.h = simhash"""
_SAME = "CASE " + " ".join(f"WHEN left(a, {k}) = left(b, {k}) THEN {k}" for k in (4, 3, 2, 1)) + " ELSE 0 END"
ORACLE["jaro_winkler_best"] = f"""WITH p AS (SELECT n_name AS name, r_name AS target, lower(n_name) AS a, lower(r_name) AS b FROM nation, region WHERE lower(n_name) <> lower(r_name)),
s AS (SELECT name, target, round(jaro_similarity(a, b) + {_SAME} * 0.1 * (1 - jaro_similarity(a, b)), 6) AS score FROM p)
SELECT name, min(target) AS target, score FROM s WHERE score >= 0.5 AND score = (SELECT max(score) FROM s o WHERE o.name = s.name) GROUP BY name, score"""
ORACLE["sbom_components"] = _F + """, v AS (SELECT package, version, list_sort(list(DISTINCT struct_pack(id := atk_id, severity := severity))) AS v FROM f GROUP BY package, version)
SELECT package, version, CAST(to_json(struct_pack(bomFormat := 'CycloneDX', specVersion := '1.5', component := struct_pack(type := 'library', name := CAST(package AS VARCHAR), version := version,
  purl := 'pkg:npm/' || replace(CAST(package AS VARCHAR), '@', '%40') || '@' || version), vulnerabilities := v)) AS VARCHAR) AS bom FROM v"""
_SCORE = "CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 80 WHEN 'medium' THEN 50 WHEN 'low' THEN 20 ELSE 50 END"
ORACLE["export_ecs"] = _F + f"""SELECT finding_id, CAST(to_json(struct_pack("@timestamp" := strftime(scanned_at, '%Y-%m-%dT00:00:00.000Z'), event := struct_pack(kind := 'alert', category := 'threat', severity := {_SCORE}), message := '[' || atk_id || '] ' || upper(severity) || ': ' || description,
  log := struct_pack(level := severity), observer := struct_pack(vendor := 'tarnwatch', product := 'tarnwatch', version := '0.1.0'), labels := struct_pack(package := CAST(f.package AS VARCHAR), version := version, atk_id := atk_id, severity := severity),
  vulnerability := struct_pack(classification := 'package-supply-chain', id := atk_id, description := description, enumeration := 'ATK'))) AS VARCHAR) AS line FROM f JOIN scans USING (scan_id)"""
