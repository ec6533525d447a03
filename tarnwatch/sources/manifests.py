"""Python manifests, workflows, indicator lists and fixtures as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.sources.lockfiles import requirements

_REQUIREMENT = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:(==|>=|<=|~=|!=|\^|~|>|<)?\s*([0-9][^\s,;'\"]*))?"


def toml_requirements(files: DataFrame) -> DataFrame:
    """pyproject.toml, poetry.lock and Pipfile (path, content) to path, name, operator, version; files that are no TOML
    give no rows. TOML has no built-in reader."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import tomllib

        pattern = re.compile(_REQUIREMENT)

        def rows(doc: dict) -> Iterator[tuple]:
            project, poetry = doc.get("project") or {}, (doc.get("tool") or {}).get("poetry") or {}
            listed = list(project.get("dependencies") or []) + [x for xs in (project.get("optional-dependencies") or {}).values() for x in xs]
            for spec in listed:
                if m := pattern.match(str(spec)):
                    yield m[1].lower(), m[2], m[3]
            tables = [poetry.get("dependencies"), poetry.get("dev-dependencies"), doc.get("packages"), doc.get("dev-packages"), *[g.get("dependencies") for g in (poetry.get("group") or {}).values()]]
            for name, spec in [kv for t in tables if isinstance(t, dict) for kv in t.items()]:
                spec = spec.get("version") if isinstance(spec, dict) else spec
                m = re.match(r"\s*(==|>=|<=|~=|!=|\^|~|>|<)?\s*([0-9][^\s,;]*)", str(spec or ""))
                yield str(name).lower(), m[1] if m else None, m[2] if m else None
            for p in doc.get("package") or []:
                if isinstance(p, dict) and p.get("name"):
                    yield str(p["name"]).lower(), "==", p.get("version")

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(path, *r) for r in rows(tomllib.loads(content or ""))]
                except (tomllib.TOMLDecodeError, AttributeError, TypeError):
                    continue
            yield pd.DataFrame(out, columns=["path", "name", "operator", "version"])

    return files.select("path", "content").mapInPandas(work, "path string, name string, operator string, version string")


def setup_requirements(files: DataFrame) -> DataFrame:
    """setup.py and setup.cfg: what stands in install_requires, read as text."""
    block = F.coalesce(
        F.nullif(F.regexp_extract("content", r"(?s)install_requires\s*=\s*\[(.*?)\]", 1), F.lit("")), F.nullif(F.regexp_extract("content", r"(?m)install_requires\s*=\s*((?:\n?[ \t]+[^\n]+)+)", 1), F.lit(""))
    )
    quoted = F.regexp_extract_all(block, F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1))
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    spec = files.select("path", F.explode(F.when(F.col("path").endswith(".py"), quoted).otherwise(lines)).alias("l"))
    part = lambda i: F.nullif(F.regexp_extract("l", _REQUIREMENT, i), F.lit(""))
    return spec.select("path", F.lower(part(1)).alias("name"), part(2).alias("operator"), part(3).alias("version")).where("name IS NOT NULL")


def python_requirements(files: DataFrame) -> DataFrame:
    """All six kinds of manifests, by their names."""
    name = F.element_at(F.split("path", "/"), -1)
    text = requirements(files.where(name.rlike(r"^requirements.*\.txt$")))
    toml = toml_requirements(files.where(name.isin("pyproject.toml", "poetry.lock", "Pipfile")))
    return text.unionByName(toml).unionByName(setup_requirements(files.where(name.isin("setup.py", "setup.cfg"))))


def workflow_steps(files: DataFrame) -> DataFrame:
    """Workflow files (path, content) to one row per step that runs something: path, job, step, run, env. A file that is
    no YAML, or is not built as workflows are, gives its run lines alone, read as text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        import yaml

        def loaded(content: str):
            # libyaml is ten times as fast, but crashes on nesting of tens of thousands; levels are no more than this.
            levels = 2 * max(map(len, content.splitlines()), default=0) + content.count("[") + content.count("{")
            return yaml.load(content, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader) if levels < 5000 else yaml.SafeLoader)

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    jobs = (loaded(content or "") or {}).get("jobs") or {}
                    for job, j in jobs.items():
                        for k, s in enumerate((j or {}).get("steps") or []):
                            if isinstance(s, dict) and s.get("run"):
                                env = {**(j.get("env") or {}), **(s.get("env") or {})}
                                rows.append((path, str(job), k, str(s["run"]), {str(a): str(b) for a, b in env.items()}))
                except (yaml.YAMLError, AttributeError, TypeError, ValueError, RecursionError):
                    rows = [(path, None, k, m.strip(), {}) for k, m in enumerate(re.findall(r"(?m)^\s*-?\s*run:\s*(.+)$", content or ""))]
                out += rows
            yield pd.DataFrame(out, columns=["path", "job", "step", "run", "env"])

    flows = files.where(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))
    return flows.select("path", "content").mapInPandas(work, "path string, job string, step int, run string, env map<string,string>")


# A request to a host that is not the forge's, a secret, and a decoded shell.
SENDS = r"(?i)curl\s+.*?https?://(?!github\.com|githubusercontent\.com|raw\.githubusercontent\.com)[^\s'\"]+"
SECRET = r"\$\{\{?\s*secrets\.\w+"
DECODES = r"base64\s+-d\s*[|>]\s*(ba)?sh"


def exfiltrating_steps(steps: DataFrame) -> DataFrame:
    """Steps (path, job, step, run, env) that send secrets to a host other than the forge, or pipe decoded text into a
    shell: path, job, step, kind; a step that does both has two rows. A step's values of env count with its script."""
    return steps.select("path", "job", "step", F.explode(_step_kinds()).alias("kind"))


def workflow_exfiltration(steps: DataFrame) -> DataFrame:
    """The workflow files (path) of such steps (run, env): path, kind, each kind once a file."""
    return steps.select("path", F.explode(_step_kinds()).alias("kind")).distinct()


def _step_kinds() -> Column:
    values = F.array_join(F.coalesce(F.map_values("env"), F.array().cast("array<string>")), " ")
    whole = F.concat(F.coalesce("run", F.lit("")), F.lit(" "), values)
    return F.array_compact(F.array(F.when(whole.rlike(SENDS) & whole.rlike(SECRET), "secret_exfiltration"), F.when(whole.rlike(DECODES), "decode_chain")))


def indicators(files: DataFrame) -> DataFrame:
    """Indicator lists (content: JSON with iocs, and waves of iocs) to one row each: wave (null outside), type, value,
    malicious_versions."""
    ioc = "array<struct<type:string,value:string,maliciousVersions:array<string>>>"
    doc = F.from_json("content", f"iocs {ioc}, waves map<string,struct<iocs:{ioc}>>")
    d = files.select(doc.alias("d"))
    own = d.select(F.lit(None).cast("string").alias("wave"), F.explode("d.iocs").alias("i"))
    waves = d.select(F.explode("d.waves").alias("wave", "w")).select("wave", F.explode("w.iocs").alias("i"))
    none = F.array().cast("array<string>")
    return own.unionByName(waves).select("wave", F.col("i.type").alias("type"), F.col("i.value").alias("value"), F.coalesce("i.maliciousVersions", none).alias("malicious_versions"))


def fixtures(spark, path: str, schema: str) -> DataFrame:
    """Campaign fixtures, one JSON object a line; lines that are none come as rows of nulls."""
    return spark.read.schema(schema).json(path)
