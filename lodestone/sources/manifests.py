"""Dependencies from package manifests: one row for each, from rows of (path, content).

JSON and line formats are read by column expressions; TOML, XML and YAML need a parser and go through an Arrow-batched function
over the distinct files. A file that cannot be read gives one row with its error.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import ship_package

SCHEMA = "path string, name string, version string, kind string, error string"


def _section(name: str, kind: str):
    entries = F.coalesce(F.map_entries(F.col(f"m.{name}")), F.array().cast("array<struct<key:string,value:string>>"))
    return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(kind).alias("kind")))


def _package_json(rows: DataFrame) -> DataFrame:
    parsed = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>")
    sections = (("dependencies", "direct"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional"))
    entries = F.flatten(F.array(*[
        _section(s, k) for s, k in sections
    ]))
    good = rows.withColumn("m", parsed).select("path", F.explode(entries).alias("e")).select("path", "e.name", F.regexp_replace("e.version", r"^[\^~>= ]+", "").alias("version"), "e.kind", F.lit(None).cast("string").alias("error"))
    bad = rows.where(F.try_parse_json("content").isNull()).select("path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("kind"), F.lit("no JSON").alias("error"))
    return good.union(bad)


def _requirements(rows: DataFrame) -> DataFrame:
    lines = rows.select("path", F.explode(F.split("content", "\n")).alias("line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> '' and not startswith(line, '#') and not startswith(line, '-')")
    name = F.regexp_extract("line", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    version = F.regexp_extract("line", r"^[A-Za-z0-9][A-Za-z0-9._-]*(?:\[[^\]]*\])?\s*(?:==|>=|<=|~=|!=|>|<)\s*([^\s,;#]+)", 1)
    return lines.where(name != "").select("path", name.alias("name"), F.when(version == "", "*").otherwise(version).alias("version"), F.lit("direct").alias("kind"), F.lit(None).cast("string").alias("error"))


def _go_mod(rows: DataFrame) -> DataFrame:
    block = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(r"(?s)require\s*\((.*?)\)"), F.lit(1)), lambda b: F.split(b, "\n")))
    single = F.regexp_extract_all("content", F.lit(r"(?m)^\s*require\s+([^\s(]+\s+\S+)"), F.lit(1))
    lines = rows.select("path", F.explode(F.concat(single, block)).alias("line")).withColumn("p", F.split(F.regexp_replace("line", r"//.*|^\s+|\s+$", ""), r"\s+"))
    return lines.where("size(p) >= 2").select("path", F.get("p", 0).alias("name"), F.regexp_replace(F.get("p", 1), "^v", "").alias("version"), F.lit("direct").alias("kind"), F.lit(None).cast("string").alias("error"))


def _cargo(content: str) -> list[tuple[str, str, str]]:
    data, out = tomllib.loads(content), []
    for section, kind in (("dependencies", "direct"), ("dev-dependencies", "dev"), ("build-dependencies", "build")):
        for name, value in data.get(section, {}).items():
            out.append((name, value if isinstance(value, str) else value.get("version", "*"), kind))
    return out


def _pyproject(content: str) -> list[tuple[str, str, str]]:
    out = []
    for line in tomllib.loads(content).get("project", {}).get("dependencies", []):
        m = re.match(r"([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(?:[=<>~!]=?\s*([^\s,;]+))?", line)
        if m:
            out.append((m[1], m[2] or "*", "direct"))
    return out


def _pom(content: str) -> list[tuple[str, str, str]]:
    out, plain = [], lambda tag: tag.rsplit("}", 1)[-1]
    for node in ElementTree.fromstring(content).iter():
        if plain(node.tag) == "dependency":
            own = {plain(c.tag): (c.text or "").strip() for c in node}
            out.append((f"{own.get('groupId', '')}:{own.get('artifactId', '')}", own.get("version") or "*", own.get("scope") or "compile"))
    return out


def _pubspec(content: str) -> list[tuple[str, str, str]]:
    out, kind = [], None
    for line in content.splitlines():
        if line and not line[0].isspace():
            kind = {"dependencies:": "direct", "dev_dependencies:": "dev"}.get(line.strip())
        elif kind and (m := re.match(r"^\s{2}([\w-]+):\s*([^\s#{]\S*)\s*(?:#.*)?$", line)):
            out.append((m[1], m[2].strip("'\"").lstrip("^~>= "), kind))
    return out


_PARSERS = {"Cargo.toml": _cargo, "pyproject.toml": _pyproject, "pom.xml": _pom, "pubspec.yaml": _pubspec}


def _parsed(rows: DataFrame) -> DataFrame:
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [(path, *x, None) for x in _PARSERS[path.rsplit("/", 1)[-1]](content or "")]
                except (ValueError, ElementTree.ParseError, AttributeError) as e:
                    out.append((path, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "name", "version", "kind", "error"])

    return rows.select("path", "content").mapInPandas(run, SCHEMA)


def dependencies(files: DataFrame) -> DataFrame:
    """path, name, version, kind, error from rows of (path, content) of the known manifests."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = [_package_json(files.where(name == "package.json")), _requirements(files.where(name == "requirements.txt")), _go_mod(files.where(name == "go.mod")), _parsed(files.where(name.isin(list(_PARSERS))))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read(spark, path: str) -> DataFrame:
    """(path, content) of the manifests below a folder."""
    names = ["package.json", "requirements.txt", "go.mod", *_PARSERS]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(path)
    return files.select("path", F.col("content").cast("string").alias("content"))
