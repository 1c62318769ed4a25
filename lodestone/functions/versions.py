"""Versions, releases and changelog mining as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.version_keys import semver

# fixed values: what the lines of release notes are searched for
VERSION_PATTERNS = (r"(?i)version\s+(\d+\.\d+(?:\.\d+)?)", r"(?i)v?(\d+\.\d+(?:\.\d+)?)", r"(?i)release\s+(\d+\.\d+(?:\.\d+)?)")
FEATURE_PATTERNS = (r"(?i)added?\s+(.+)", r"(?i)new\s+(.+)", r"(?i)introduced?\s+(.+)", r"(?i)implemented?\s+(.+)", r"(?i)stabilized?\s+(.+)")
BREAKING_PATTERNS = (r"(?i)breaking\s+change", r"(?i)backward.incompatible", r"(?i)removed?\s+(.+)", r"(?i)changed?\s+(.+)")
DEPRECATION_PATTERNS = (r"(?i)deprecated?\s+(.+)", "(?i)obsolete", r"(?i)will\s+be\s+removed")
SYNTAX_PATTERNS = (r"(?i)syntax\s+(.+)", r"(?i)grammar\s+(.+)", r"(?i)parser\s+(.+)")
CATEGORIES = {
    "rust": ((("async", "await"), "Async"), (("trait", "type"), "TypeSystem"), (("macro",), "Macros"), (("std", "library"), "StandardLibrary"), (("cargo",), "Toolchain"), ((), "Syntax")),
    "python": ((("async", "await"), "Async"), (("typing", "type"), "TypeSystem"), (("import", "module"), "Modules"), ((), "StandardLibrary")),
    "javascript": ((("async", "promise"), "Async"), (("class", "prototype"), "Syntax"), (("module", "import"), "Modules"), ((), "StandardLibrary")),
}


def is_semver(tag: Column) -> Column:
    return tag.rlike(r"^\d+\.\d+\.\d+(-.*)?$")


def is_prerelease(tag: Column) -> Column:
    return F.lower(tag).rlike("alpha|beta|rc")


def sort_key(version: Column) -> Column:
    """Key that orders versions of no named standard: SemVer's; null for what is none."""
    return semver(version)


def needs_update(current: Column, target: Column) -> Column:
    """Whether the target is the later version by SemVer; null where one of them is none."""
    return semver(target) > semver(current)


def from_output(text: Column) -> Column:
    """Version that a tool prints: number triples first, then pairs, with or without a v."""
    tries = (r"(\d+\.\d+\.\d+)", r"v(\d+\.\d+)", r"[vV]ersion\s+(\S+)", r"(\d+\.\d+)")
    return F.coalesce(*[F.nullif(F.regexp_extract(text, t, 1), F.lit("")) for t in tries])


def mined_versions(text: Column) -> Column:
    """Distinct versions, pattern by pattern and then by place."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in VERSION_PATTERNS]))


def mined(text: Column, patterns, minimum: int = 5) -> Column:
    """What the patterns' groups catch (the whole match where there is no group), of more than ``minimum`` bytes, trimmed."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1 if "(.+)" in p else 0)) for p in patterns]
    return F.filter(F.transform(F.concat(*found), lambda x: F.trim(x)), lambda x: F.octet_length(x) > minimum)


def feature_name(description: Column) -> Column:
    return F.trim(F.regexp_extract(description, r"^([^:(\[]*)", 1))


def feature_category(description: Column, language: Column) -> Column:
    lower, out = F.lower(description), F.lit("Other")
    for name, rules in CATEGORIES.items():
        own = F.lit(rules[-1][1])
        for words, category in reversed(rules[:-1]):
            own = F.when(lower.rlike("|".join(words)), F.lit(category)).otherwise(own)
        out = F.when(language == name, own).otherwise(out)
    return out


def severity(label: Column) -> Column:
    upper = F.upper(F.trim(label))
    return (
        F.when(upper.isin("CRITICAL", "SEVERE"), "CRITICAL")
        .when(upper.isin("HIGH", "IMPORTANT"), "HIGH")
        .when(upper.isin("MEDIUM", "MODERATE"), "MEDIUM")
        .when(upper.isin("LOW", "MINOR"), "LOW")
        .otherwise("UNKNOWN")
    )
