"""Findings in the forms that other tools read: one row per finding or per scan, built by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions import severity as S

PRODUCT, VERSION = "tarnwatch", "0.1.0"

# Severities of the event formats, and control tables of the compliance reports.
CEF = {"critical": 10, "high": 8, "medium": 5, "low": 2}
ECS = {"critical": 100, "high": 80, "medium": 50, "low": 20}
QID = {"critical": 90050001, "high": 90050002, "medium": 90050003, "low": 90050004}
NIST = {
    "ATK-001": ("SR-3.1", "Malicious code detection"),
    "ATK-002": ("SR-4.2", "Code obfuscation analysis"),
    "ATK-003": ("SR-5.3", "Credential protection"),
    "ATK-004": ("SR-6.4", "Persistence monitoring"),
    "ATK-005": ("SR-7.5", "Data exfiltration prevention"),
    "ATK-006": ("SR-2.2", "Dependency validation"),
    "ATK-007": ("SR-2.1", "Typosquatting prevention"),
    "ATK-008": ("SR-8.1", "Integrity verification"),
    "ATK-009": ("SR-9.2", "Conditional behavior analysis"),
    "ATK-010": ("SR-10.3", "Anti-evasion detection"),
    "ATK-011": ("SR-11.4", "Supply chain propagation monitoring"),
}
STIG = {
    "SRG-APP-000141": ("ATK-001", "Application Malware Detection"),
    "SRG-APP-000142": ("ATK-002", "Application Code Obfuscation"),
    "SRG-APP-000143": ("ATK-003", "Credential Harvesting"),
    "SRG-APP-000144": ("ATK-004", "Persistence Mechanisms"),
    "SRG-APP-000145": ("ATK-005", "Data Exfiltration"),
    "SRG-APP-000146": ("ATK-006", "Dependency Confusion"),
    "SRG-APP-000147": ("ATK-007", "Typosquatting"),
    "SRG-APP-000148": ("ATK-008", "Tarball Tampering"),
    "SRG-APP-000149": ("ATK-009", "Dormant Triggers"),
    "SRG-APP-000150": ("ATK-010", "Sandbox Evasion"),
    "SRG-APP-000151": ("ATK-011", "Transitive Propagation"),
}
CRA = [
    ("Art. 7", "Secure by default configuration", "ATK-001"), ("Art. 7", "Secure by default configuration", "ATK-010"), ("Art. 10(1)", "Vulnerability disclosure", "ATK-008"),
    ("Art. 10(2)", "Known vulnerability reporting", "ATK-006"), ("Art. 11", "Software Bill of Materials", "ATK-008"), ("Art. 11", "Software Bill of Materials", "ATK-006"),
    ("Annex I(1.1)", "No known exploitable vulnerabilities", "ATK-009"), ("Annex I(1.3)", "Least privilege", "ATK-003"), ("Annex I(1.5)", "Limited attack surface", "ATK-002"),
    ("Annex I(1.5)", "Limited attack surface", "ATK-004"), ("Annex I(1.5)", "Limited attack surface", "ATK-005"), ("Annex I(2.1)", "Protection against unauthorized access", "ATK-003"),
    ("Annex I(2.3)", "Data integrity", "ATK-008"), ("Annex I(2.3)", "Data integrity", "ATK-011"), ("Annex I(3.2)", "Incident detection and reporting", "ATK-009"),
    ("Annex I(3.2)", "Incident detection and reporting", "ATK-010"), ("Annex I(3.3)", "Supply chain security monitoring", "ATK-011"), ("Annex I(3.3)", "Supply chain security monitoring", "ATK-007"),
]


def _bar(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def _text(c: Column) -> Column:
    return _bar(F.replace(c, F.lit("\\"), F.lit("\\\\")))


def cef(findings: DataFrame) -> DataFrame:
    """findings: finding_id, package, version, atk_id, severity, description."""
    pkg, ver, desc = _bar(F.coalesce(F.col("package").cast("string"), F.lit("unknown"))), _bar(F.coalesce("version", F.lit(""))), _text(F.coalesce("description", F.lit("")))
    line = F.concat_ws(
        "|", F.lit("CEF:0"), F.lit(PRODUCT), F.lit(PRODUCT), F.lit(VERSION), "atk_id", desc,
        S.lookup(F.col("severity"), CEF, 5).cast("string"), F.concat(F.lit("suser="), pkg, F.lit(" "), ver), F.concat(F.lit("msg="), desc),
        F.concat(F.lit("cs1="), "atk_id"), F.lit("cs1Label=atkId"), F.concat(F.lit("cs2="), "severity"), F.lit("cs2Label=severity"),
        F.concat(F.lit("cs3="), pkg), F.lit("cs3Label=package"), F.concat(F.lit("cs4="), ver), F.lit("cs4Label=version"),
    )
    return findings.select("finding_id", line.alias("line"))


def ecs(findings: DataFrame, at: str = "scanned_at") -> DataFrame:
    message = F.concat(F.lit("["), "atk_id", F.lit("] "), F.upper("severity"), F.lit(": "), F.coalesce("description", F.lit("Unknown finding")))
    event = F.struct(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"),
        F.struct(F.lit("alert").alias("kind"), F.lit("threat").alias("category"), S.lookup(F.col("severity"), ECS, 50).alias("severity")).alias("event"),
        message.alias("message"),
        F.struct(F.col("severity").alias("level")).alias("log"),
        F.struct(F.lit(PRODUCT).alias("vendor"), F.lit(PRODUCT).alias("product"), F.lit(VERSION).alias("version")).alias("observer"),
        F.struct(F.col("package").cast("string").alias("package"), "version", "atk_id", "severity").alias("labels"),
        F.struct(F.lit("package-supply-chain").alias("classification"), F.col("atk_id").alias("id"), "description", F.lit("ATK").alias("enumeration")).alias("vulnerability"),
    )
    return findings.select("finding_id", F.to_json(event).alias("line"))


def qradar(findings: DataFrame) -> DataFrame:
    label = F.initcap(F.when(F.col("severity").isin(*QID), F.col("severity")).otherwise("medium"))
    event = F.struct(
        F.lit(PRODUCT).alias("source"), F.concat_ws("\t", F.col("package").cast("string"), "version", "atk_id", "severity", F.coalesce("description", F.lit(""))).alias("devicepayload"),
        "atk_id", "severity", F.col("package").cast("string").alias("package_name"), F.col("version").alias("package_version"),
        F.coalesce("description", F.lit("")).alias("finding_title"), S.lookup(F.col("severity"), QID, QID["medium"]).alias("qid"), F.concat(label, F.lit(" Severity Malware")).alias("category"),
    )
    return findings.select("finding_id", F.to_json(event).alias("line"))


def sentinel(findings: DataFrame) -> DataFrame:
    event = F.struct(
        F.lit(PRODUCT).alias("SourceSystem"), F.col("severity").alias("SeverityLevel"), F.upper("severity").alias("Severity"), F.col("atk_id").alias("ATKId"),
        F.coalesce("description", F.lit("")).alias("FindingTitle"), F.col("package").cast("string").alias("PackageName"), F.col("version").alias("PackageVersion"),
    )
    return findings.select("finding_id", F.to_json(event).alias("line"))


def csv(findings: DataFrame) -> DataFrame:
    """Commas become semicolons; lists and structs are serialised before they get here."""
    plain = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(","), F.lit(";"))
    return findings.select("finding_id", F.concat_ws(",", *[plain(c) for c in ("package", "version", "atk_id", "severity", "description")]).alias("line"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Distinct rules, each with the first description by finding and its results at each level."""
    level = sarif_level(F.col("severity"))
    return findings.groupBy("atk_id").agg(
        F.min_by("description", "finding_id").alias("description"), *[F.count_if(level == x).alias(x) for x in ("error", "warning", "note")]
    )


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result per finding with its distinct locations (file, line; line 1 where unknown)."""
    place = F.struct(F.col("file"), F.coalesce("line", F.lit(1)).alias("line"))
    g = findings.groupBy("finding_id", "atk_id", "severity").agg(F.array_sort(F.collect_set(place)).alias("locations"))
    result = F.struct(F.col("atk_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.col("locations"))
    return g.select("finding_id", F.to_json(result).alias("result"))


def control_table(findings: DataFrame, controls: DataFrame) -> DataFrame:
    """Every control with its findings, those without any too: controls left join counts."""
    n = findings.groupBy("atk_id").agg(F.count("*").alias("__n"))
    j = controls.join(n, "atk_id", "left")
    out = j.withColumn("findings", F.coalesce("__n", F.lit(0)).cast("long")).drop("__n")
    return out.withColumn("status", F.when(F.col("findings") > 0, "FAIL").otherwise("PASS"))


def nist_controls(spark) -> DataFrame:
    return spark.createDataFrame([(k, c, t) for k, (c, t) in NIST.items()], "atk_id string, control string, title string")


def stig_controls(spark) -> DataFrame:
    return spark.createDataFrame([(a, s, t) for s, (a, t) in STIG.items()], "atk_id string, control string, title string")


def cra_controls(spark) -> DataFrame:
    return spark.createDataFrame(CRA, "article string, title string, atk_id string")


def by_severity(findings: DataFrame) -> DataFrame:
    """The worst findings first, then by package and id."""
    return findings.orderBy(S.rank(F.col("severity")).desc(), "package", "atk_id", "finding_id")


def scan_text(findings: DataFrame) -> DataFrame:
    """Per scan: worst severity and the count of each."""
    return findings.groupBy("scan_id").agg(
        S.from_rank(F.max(S.rank(F.col("severity")))).alias("worst"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    )


def badges(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scans that have each severity at least once, and scans without findings."""
    f = findings.groupBy("scan_id").agg(*[F.max((F.col("severity") == s).cast("int")).alias(s) for s in ("critical", "high", "medium", "low")])
    j = scans.select("scan_id").join(f, "scan_id", "left")
    clean = F.count_if(F.col("critical").isNull())
    return j.agg(*[F.count_if(F.col(s) == 1).alias(s) for s in ("critical", "high", "medium", "low")], clean.alias("clean"), F.count("*").alias("scans"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and distinct packages, over all findings."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")], F.countDistinct("package").alias("packages"))


def sbom(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """One CycloneDX component per package and version, with its vulnerabilities."""
    v = findings.groupBy("package", "version").agg(F.array_sort(F.collect_set(F.struct(F.col("atk_id").alias("id"), F.col("severity")))).alias("vulnerabilities"))
    j = packages.join(v, ["package", "version"], "left")
    name = F.col("package").cast("string")
    purl = F.concat(F.lit("pkg:npm/"), F.replace(name, F.lit("@"), F.lit("%40")), F.lit("@"), F.col("version"))
    doc = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.struct(F.lit("library").alias("type"), name.alias("name"), "version", purl.alias("purl")).alias("component"), "vulnerabilities")
    return j.select("package", "version", F.to_json(doc).alias("bom"))


def spdx(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """One SPDX document per package and version, with an annotation for each of its findings; it bears no time of its
    own, so that the same input gives the same document."""
    note = F.concat(F.lit("["), "atk_id", F.lit("] "), F.upper("severity"), F.lit(": "), F.coalesce("description", F.lit("")))
    a = findings.groupBy("package", "version").agg(F.array_sort(F.collect_set(note)).alias("notes"))
    j = packages.join(a, ["package", "version"], "left")
    name = F.col("package").cast("string")
    purl = F.concat(F.lit("pkg:npm/"), name, F.lit("@"), F.col("version"))
    ref = F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), purl.alias("referenceLocator"))
    own = F.struct(F.lit("SPDXRef-Package").alias("SPDXID"), name.alias("name"), F.col("version").alias("versionInfo"), F.lit("LIBRARY").alias("primaryPackagePurpose"), F.array(ref).alias("externalRefs"))
    notes = F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda n: F.struct(F.lit("OTHER").alias("annotationType"), F.lit(f"Tool: {PRODUCT}").alias("annotator"), n.alias("comment")))
    doc = F.struct(
        F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), F.concat(name, F.lit("@"), "version").alias("name"),
        F.array(own).alias("packages"), notes.alias("annotations"),
    )
    return j.select("package", "version", F.to_json(doc).alias("spdx"))


def signed(manifests: DataFrame, body: str, key: bytes, into: str = "hmac") -> DataFrame:
    """HMAC-SHA256 of a column under a key, in hex, by its definition on two SHA-256 digests."""
    from hashlib import sha256

    k = (sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(c ^ x for c in k).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.col(body).cast("binary")), 256))
    return manifests.withColumn(into, F.sha2(F.concat(pad(0x5C), inner), 256))


def provenance(manifests: DataFrame) -> DataFrame:
    """SHA-256 of a rule with its indicators, in their order."""
    return manifests.select("rule", F.sha2(F.concat_ws("\n", "rule", F.array_join(F.array_sort("indicators"), "\n")), 256).alias("digest"))
