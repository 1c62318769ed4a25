"""Keys that order versions as text: SemVer 2.0, PEP 440 and Maven.

A key is a string whose order by bytes is the standard's order of versions, so it works in sorts, joins, range partitions and
windows alike, in Spark and elsewhere. A number of any size is written as its length (three digits) and its digits. Where a list may go on, its end is a
sign below all that could follow. What a standard does not read as a version has a null key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEMVER = r"^\s*[vV=]*\s*(\d+(?:\.\d+)*)(?:-([0-9A-Za-z.-]+)|([A-Za-z][0-9A-Za-z.-]*))?(?:\+[0-9A-Za-z.-]*)?\s*$"
_PEP440 = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)"
    r"(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?(\d*))?"
    r"(?:(-)(\d+)|[-_.]?(post|rev|r)[-_.]?(\d*))?"
    r"(?:[-_.]?(dev)[-_.]?(\d*))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*$"
)
# fixed values: Maven's qualifiers before a release, in order; those that mean the release itself; short forms before a number
MAVEN_BEFORE = (("alpha",), ("beta",), ("milestone",), ("rc", "cr"), ("snapshot",))
MAVEN_RELEASE = ("", "final", "ga", "release")
MAVEN_SHORT = {"a": "alpha", "b": "beta", "m": "milestone"}


def _number(digits: Column) -> Column:
    plain = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 3, "0"), plain)


def _numbers(dotted: Column) -> Column:
    """Numbers between dots without zeros at the end; the end is a space."""
    parts = F.split(F.regexp_replace(dotted, r"(\.0+)+$", ""), r"\.")
    return F.concat(F.array_join(F.transform(parts, _number), ""), F.lit(" "))


def semver(version: Column) -> Column:
    """SemVer 2.0. A leading v, missing and further numbers are taken too, and a pre-release that follows a number without its hyphen."""
    group = lambda k: F.regexp_extract(version, _SEMVER, k)
    before = F.concat(group(2), group(3))
    piece = lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), _number(x))).otherwise(F.concat(F.lit("1"), x, F.lit(" ")))
    pieces = F.array_join(F.transform(F.split(before, r"\."), piece), "")
    key = F.concat(_numbers(group(1)), F.when(before == "", "1").otherwise(F.concat(F.lit("0"), pieces)))
    return F.when(version.rlike(_SEMVER), key)


def pep440(version: Column) -> Column:
    """PEP 440: epoch, release, pre, post, dev and local parts in all spellings that it normalises."""
    group = lambda k: F.lower(F.regexp_extract(version, _PEP440, k))
    count = lambda x: _number(F.when(x == "", "0").otherwise(x))
    pre, post, dev, local = group(3), F.concat(group(5), group(7)), group(9), group(11)
    letter = F.when(pre.isin("a", "alpha"), "a").when(pre.isin("b", "beta"), "b").otherwise("c")
    key = F.concat(
        count(group(1)),
        _numbers(group(2)),
        F.when(pre != "", F.concat(letter, count(group(4)))).when((post == "") & (dev != ""), "0").otherwise("z"),
        F.when(post == "", "0").otherwise(F.concat(F.lit("1"), count(F.concat(group(6), group(8))))),
        F.when(dev == "", "1").otherwise(F.concat(F.lit("0"), count(group(10)))),
        F.when(local == "", "").otherwise(F.array_join(F.transform(F.split(local, "[-_.]"), lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("2"), _number(x))).otherwise(F.concat(F.lit("1"), x, F.lit(" ")))), "")),
    )
    return F.when(version.rlike(_PEP440), key)


def maven(version: Column) -> Column:
    """Maven's order of tokens between dots, hyphens and changes from digits to letters, with the separator before each. Anything but an
    empty text is a version."""
    text = F.lower(F.trim(version))
    for pattern, new in (
        ("_", "-"),
        (r"(?<=\d)(?=[^\d.-])|(?<=[^\d.-])(?=\d)", "-"),
        (r"(^|(?<=[.-]))(?=[.-]|$)", "0"),
        *[(rf"(?<=[.-]){short}(?=-\d)", word) for short, word in MAVEN_SHORT.items()],
        (r"\.(?=[^\d.-])", "-"),
        (rf"(?<=[.-])({'|'.join(w for w in MAVEN_RELEASE if w)})(?=[.-]|$)", "~"),
        (r"([.-](0+|~))+(?=-|$)", ""),
    ):
        text = F.regexp_replace(text, pattern, new)
    tokens = F.regexp_extract_all(text, F.lit(r"([.-]?[^.-]+)"), F.lit(1))

    def token(x: Column, at: Column) -> Column:
        name = F.regexp_replace(x, "^[.-]", "")
        out = F.when(name.rlike(r"^\d+$"), F.concat(F.when(x.startswith("-"), "9").otherwise("A"), _number(name)))
        for k, words in enumerate(MAVEN_BEFORE, 1):
            out = out.when(name.isin(*words), str(k))
        return out.when(name == "~", "6").when(name == "sp", "7").otherwise(F.concat(F.lit("8"), name, F.lit(" ")))

    key = F.concat(F.array_join(F.transform(tokens, token), ""), F.lit("6"))
    return F.when(F.trim(version) != "", key)


SCHEMES = {"semver": semver, "pep440": pep440, "maven": maven}
#: Which standard a registry's versions follow; others follow SemVer.
ECOSYSTEMS = {"pypi": "pep440", "python": "pep440", "maven": "maven", "java": "maven"}


def key(version: Column, ecosystem: Column | None = None) -> Column:
    """The key of each row's own standard; ``ecosystem``: a registry or language."""
    if ecosystem is None:
        return semver(version)
    name = F.lower(ecosystem)
    out = semver(version)
    for scheme in ("pep440", "maven"):
        out = F.when(name.isin(*[e for e, s in ECOSYSTEMS.items() if s == scheme]), SCHEMES[scheme](version)).otherwise(out)
    return out
