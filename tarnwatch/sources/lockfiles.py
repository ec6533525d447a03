"""Lockfiles as rows, and rules over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lockfile_format(path: Column, content: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return (
        F.when(name == "yarn.lock", "yarn").when(name.rlike(r"pnpm-lock\.ya?ml$"), "pnpm").when(name.endswith(".json"), "npm")
        .when(F.ltrim(content).startswith("{"), "npm").when(content.contains("__metadata") | content.contains("@npm:"), "yarn")
    )


def npm_packages(files: DataFrame) -> DataFrame:
    """npm lockfiles (path, content) to one row per package; the root, key '', is left out. Scopes stay in names."""
    entry = "version string, resolved string, integrity string, dev boolean, optional boolean, dependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>"
    doc = F.from_json("content", f"lockfileVersion int, packages map<string, struct<{entry.replace(' string', ':string').replace(' boolean', ':boolean').replace(' map', ':map')}>>")
    rows = files.select("path", F.explode(doc["packages"]).alias("at", "p")).where("at <> ''")
    return rows.select("path", F.element_at(F.split("at", "node_modules/"), -1).alias("name"), "at", "p.*")


def yarn_packages(files: DataFrame) -> DataFrame:
    """yarn.lock (path, content): a header line opens an entry, indented lines belong to it."""
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("n", "line")).where("line NOT RLIKE '^\\\\s*(#|$)'")
    head = F.col("line").rlike(r"^\S.*:$").cast("int")
    block = F.sum(head).over(Window.partitionBy("path").orderBy("n"))
    b = lines.withColumn("entry", block).where("entry > 0")
    first = lambda p: F.max(F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)))
    g = b.groupBy("path", "entry").agg(
        first(r"^\"?((?:@[^/@\"]+/)?[^@\"]+)@").alias("name"), first(r"^\s+version:?\s+\"?([^\"\s]+)").alias("version"),
        first(r"^\s+resolved\s+\"?([^\"\s]+)").alias("resolved"), first(r"^\s+integrity\s+(\S+)").alias("integrity"),
    )
    return g.withColumn("resolved", F.replace("resolved", F.lit("registry.yarnpkg.com"), F.lit("registry.npmjs.org"))).drop("entry")


def pnpm_packages(files: DataFrame) -> DataFrame:
    """pnpm lockfiles (path, content); YAML has no built-in reader."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    doc = yaml.safe_load(content) or {}
                except yaml.YAMLError:
                    continue
                for key, p in (doc.get("packages") or {}).items():
                    name, _, version = str(key).lstrip("/").split("(")[0].rpartition("@")
                    out.append((path, name, version, ((p or {}).get("resolution") or {}).get("integrity")))
            yield pd.DataFrame(out, columns=["path", "name", "version", "integrity"])

    return files.select("path", "content").mapInPandas(work, "path string, name string, version string, integrity string")


def numbered_requirements(files: DataFrame) -> DataFrame:
    """requirements.txt (path, content) to line, name, operator and version; null where unpinned."""
    lines = files.select("path", F.posexplode(F.split("content", "\r?\n")).alias("line", "l")).select("path", "line", F.trim(F.regexp_replace("l", r"\s*#.*$", "")).alias("l"))
    lines = lines.where("l <> '' AND l NOT LIKE '-%'")
    part = lambda i: F.nullif(F.regexp_extract("l", r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:(==|>=|<=|~=|!=|>|<)\s*([^\s,;]+))?", i), F.lit(""))
    return lines.select("path", "line", F.lower(part(1)).alias("name"), part(2).alias("operator"), part(3).alias("version")).where("name IS NOT NULL")


def requirements(files: DataFrame) -> DataFrame:
    return numbered_requirements(files).drop("line")


def lockfile_totals(packages: DataFrame) -> DataFrame:
    return packages.groupBy("path").agg(F.count("*").alias("total"), F.count_if("dev").alias("dev"), F.count_if("optional").alias("optional"))


def graph_rules(packages: DataFrame) -> DataFrame:
    """Peers named like plugins (high), many nested dependencies (medium), many optional ones (low)."""
    empty = F.create_map().cast("map<string,string>")
    names = lambda c: F.map_keys(F.coalesce(c, empty))
    peers = F.filter(names(F.col("peerDependencies")), lambda n: n.rlike("plugin|hook|ext"))
    nested = F.size(F.filter(names(F.col("dependencies")), lambda n: n.contains("/")))
    rules = F.array_compact(F.array(
        F.when(F.size(peers) > 0, "high"), F.when((F.size(names(F.col("dependencies"))) > 5) & (nested > 3), "medium"), F.when(F.size(names(F.col("optionalDependencies"))) > 10, "low")
    ))
    return packages.select("path", "name", F.explode(rules).alias("severity"))


def tarballs(files: DataFrame) -> DataFrame:
    """binaryFile rows (path, content) of packed packages to one row per member, first folder stripped, bytes kept.

    Members stream one at a time; a tarball that can't be read gives no rows."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import tarfile

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                        for m in tar:
                            if m.isfile() and "/node_modules/" not in m.name:
                                data = tar.extractfile(m).read()
                                name = m.name.partition("/")[2] or m.name
                                yield pd.DataFrame([(path, name, data, len(data))], columns=["archive", "path", "bytes", "size"])
                except (tarfile.TarError, OSError, EOFError):
                    continue

    return files.select("path", "content").mapInPandas(work, "archive string, path string, bytes binary, size bigint")
