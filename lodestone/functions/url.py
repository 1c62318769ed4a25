"""URL analytics as column expressions: parts, features, authority, type, confidence, version."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: domains, words and aliases that the scores look for
HIGH_AUTHORITY = (
    "github.com", "docs.rs", "pypi.org", "npmjs.com", "maven.org", "golang.org", "rust-lang.org", "python.org", "nodejs.org",
    "oracle.com", "microsoft.com", "mozilla.org", "apache.org", "stackoverflow.com", "developer.mozilla.org", "w3.org",
)
MEDIUM_AUTHORITY = (
    "readthedocs.io", "gitbook.io", "confluence.atlassian.com", "wiki.archlinux.org", "ubuntu.com", "debian.org", "fedoraproject.org",
)
OFFICIAL = ("rust-lang.org", "python.org", "nodejs.org", "golang.org", "oracle.com", "microsoft.com", "docs.rs", "pypi.org")
DOC_SITES = (
    "docs.rs", "readthedocs.io", "github.io", "gitbook.io", "confluence", "notion.so", "gitiles", "docs.python.org", "nodejs.org",
    "golang.org", "rust-lang.org",
)
TLD_SCORES = ((".org", 0.6), (".edu", 0.8), (".gov", 0.9), (".com", 0.4), (".io", 0.5))
DOC_PATHS = "docs documentation api reference guide tutorial manual help wiki readme changelog examples".split()
ALIASES = {"rust": ("rs", "cargo"), "python": ("py", "pypi"), "javascript": ("js", "npm", "node"), "java": ("maven", "gradle"), "go": ("golang",)}
INDICATORS = {
    "rust": ("rs", "cargo", "crates"), "python": ("py", "pypi", "pip"), "javascript": ("js", "npm", "node"),
    "java": ("maven", "gradle", "jdk"), "go": ("golang", "pkg.go.dev"),
}
PATH_TYPES = (
    ("ApiReference", ("api", "reference"), 0.25), ("Tutorial", ("tutorial", "guide"), 0.2), ("Example", ("example", "sample"), 0.15),
    ("Changelog", ("changelog", "release"), 0.1), ("Download", ("download",), 0.05), ("Documentation", ("doc", "manual"), 0.3),
)
VERSION_MARKS = ("v1.", "v2.", "v3.", "v4.", "v5.", "/1.", "/2.", "/3.", "/4.", "/5.")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def _has(text: Column, words) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(text, F.lit(w))
    return test


def depth(p: Column) -> Column:
    return F.size(F.filter(F.split(p, "/"), lambda s: s != ""))


def extension(p: Column) -> Column:
    """What follows the last dot of the last segment, null without a dot."""
    last = F.element_at(F.split(p, "/"), -1)
    return F.when(F.contains(last, F.lit(".")), F.element_at(F.split(last, r"\."), -1))


def has_version(p: Column) -> Column:
    return p.rlike(r"v?\d+\.\d+(\.\d+)?|version[/-]?\d+|release[/-]?\d+")


def doc_words(p: Column) -> Column:
    """Times that documentation words occur, the leftmost and then the first of the list, without overlaps."""
    return F.size(F.regexp_extract_all(p, F.lit("|".join(DOC_PATHS)), F.lit(0)))


def authority(h: Column) -> Column:
    by_end = F.lit(0.3)
    for end, score in reversed(TLD_SCORES):
        by_end = F.when(h.endswith(end), F.lit(score)).otherwise(by_end)
    docs = F.when(h.startswith("docs.") | F.contains(h, F.lit("documentation")), 0.2).otherwise(0.0)
    api = F.when(F.contains(h, F.lit("api")), 0.15).otherwise(0.0)
    wiki = F.when(F.contains(h, F.lit("wiki")), 0.1).otherwise(0.0)
    score = F.when(_has(h, HIGH_AUTHORITY), F.lit(0.9)).when(_has(h, MEDIUM_AUTHORITY), F.lit(0.7)).otherwise(by_end + docs + api + wiki)
    return F.least(score, F.lit(1.0))


def is_official(h: Column) -> Column:
    return _has(h, OFFICIAL)


def is_doc_site(h: Column) -> Column:
    return _has(h, DOC_SITES)


def subdomain_type(h: Column) -> Column:
    return (
        F.when(h.startswith("docs.") | F.contains(h, F.lit("documentation")), "Docs")
        .when(F.contains(h, F.lit("api")), "Api")
        .when(F.contains(h, F.lit("wiki")), "Wiki")
        .when(F.contains(h, F.lit("blog")), "Blog")
        .when(F.contains(h, F.lit("download")), "Download")
        .otherwise("Other")
    )


def path_type(p: Column) -> Column:
    lower, out = F.lower(p), F.lit("Other")
    for name, words, _ in reversed(PATH_TYPES):
        out = F.when(_has(lower, words), F.lit(name)).otherwise(out)
    return out


def path_score(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, _, score in PATH_TYPES:
        out = F.when(kind == name, F.lit(score)).otherwise(out)
    return out


def language_match(url: Column, language: str) -> Column:
    lower = F.lower(url)
    own = F.contains(lower, F.lit(language.lower()))
    return F.when(own, 0.8).when(_has(lower, ALIASES.get(language.lower(), ())), 0.6).otherwise(0.2)


def language_indicators(url: Column, language: str) -> Column:
    lower = F.lower(url)
    words = (language.lower(), *INDICATORS.get(language.lower(), ()))
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(lower, w))


def relevance(url: Column, language: str) -> Column:
    h, p = host(url), path(url)
    flag = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    score = (
        flag(is_doc_site(h), 0.3) + 0.2 * authority(h) + flag(is_official(h), 0.2) + F.least(0.05 * doc_words(p), F.lit(0.2))
        + flag(has_version(p), 0.1) + path_score(path_type(p)) + 0.2 * language_match(url, language)
    )
    return F.least(score, F.lit(1.0))


def relevance_confidence(url: Column, language: str) -> Column:
    h, p = host(url), path(url)
    flag = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    return F.least(relevance(url, language) + flag(is_doc_site(h), 0.1) + flag(is_official(h), 0.1) + flag(has_version(p), 0.05), F.lit(1.0))


def discovery(url: Column, language: str) -> Column:
    """struct(url_type, confidence, priority) of a discovered URL."""
    u = F.lower(url)
    lang, git = F.contains(u, F.lit(language.lower())), F.contains(u, F.lit("github.com"))
    release = git & F.contains(u, F.lit("/releases"))
    change, tags, docs = _has(u, ("changelog", "changes")), _has(u, ("releases", "tags", "versions")), _has(u, ("docs", "documentation", "wiki"))
    kind = F.when(change, "Changelog").when(release, "GitHubRelease").when(tags, "ReleaseNotes").when(docs, "Documentation").otherwise("Unknown")
    flag = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    confidence = 0.1 + flag(lang, 0.3) + flag(git, 0.2) + flag(release, 0.3) + flag(change, 0.4) + flag(tags, 0.3) + flag(docs, 0.2)
    priority = F.when(release, 1).when(change | tags, 2).when(docs, 3).otherwise(5)
    return F.struct(kind.alias("url_type"), F.least(confidence, F.lit(1.0)).alias("confidence"), priority.cast("int").alias("priority"))


def version(url: Column) -> Column:
    """Version after the first mark of the list that the URL holds: digits and dots, null without any."""
    found = []
    for mark in VERSION_MARKS:
        escaped = mark.replace(".", r"\.")
        found.append(F.nullif(F.regexp_extract(url, rf"{escaped[0]}({escaped[1:]}[0-9.]*)", 1), F.lit("")))
    return F.coalesce(*found)


def candidates(base: Column, versions: Column) -> Column:
    """URLs that may hold a version's notes, for explode."""
    tails = ("/v", "/", "/version/", "/release/", "/tag/", "/releases/tag/v", "/releases/tag/")
    return F.flatten(F.transform(versions, lambda v: F.array(*[F.concat(base, F.lit(t), v) for t in tails])))


# fixed values: where change logs and documentation are looked for
RELEVANT_PARTS = ("changelog", "changes", "history", "releases", "tags", "versions", "docs", "documentation", "wiki")
LOG_PATHS = ("/changelog", "/changes", "/releases", "/history", "/whatsnew", "/news", "/updates", "/versions")
COMMON_PATHS = (
    "/changelog", "/CHANGELOG", "/Changelog", "/changelog.md", "/CHANGELOG.md", "/changes", "/CHANGES", "/changes.md", "/CHANGES.md", "/releases", "/release", "/releases.html", "/news", "/history",
    "/whatsnew", "/updates", "/versions",
)
LOG_FILES = tuple(f"/blob/{branch}/{name}.md" for name in ("CHANGELOG", "CHANGES", "HISTORY") for branch in ("main", "master"))


def is_relevant(url: Column, language: str) -> Column:
    """Whether the lower-cased URL holds the language or a word of change logs, releases or documentation."""
    lower = F.lower(url)
    return F.exists(F.array(*[F.lit(w) for w in (language.lower(), *RELEVANT_PARTS)]), lambda w: F.contains(lower, w))


def _below(base: Column, paths) -> Column:
    return F.transform(F.array(*[F.lit(p) for p in paths]), lambda p: F.concat(base, p))


def documentation_urls(url: Column) -> Column:
    return _below(F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1), LOG_PATHS)


def common_urls(url: Column) -> Column:
    return _below(F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1), COMMON_PATHS)


def repository_urls(url: Column) -> Column:
    """Pages of a repository on the code host where releases and changes are told, and its API; empty for other URLs."""
    owner, name = (F.regexp_extract(url, r"^https?://github\.com/([^/?#]+)/([^/?#]+)", k) for k in (1, 2))
    base = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name)
    pages = _below(base, ("/releases", "/tags", *LOG_FILES, "/wiki"))
    more = F.array(F.concat(F.lit("https://"), owner, F.lit(".github.io/"), name), F.concat(F.lit("https://api.github.com/repos/"), owner, F.lit("/"), name, F.lit("/releases")))
    return F.when(owner != "", F.concat(pages, more)).otherwise(F.array().cast("array<string>"))


# fixed values: where sites keep documentation
DOC_FOLDERS = ("/docs", "/documentation", "/api", "/reference", "/guide", "/tutorial", "/examples", "/readme", "/manual", "/help", "/wiki", "/getting-started")
LANGUAGE_FOLDERS = {
    "rust": ("/rustdoc", "/docs/rust", "/doc", "/book"), "python": ("/docs/python", "/py-modindex.html", "/sphinx", "/pydoc"), "javascript": ("/docs/js", "/jsdoc", "/typedoc", "/api/js"),
    "typescript": ("/docs/js", "/jsdoc", "/typedoc", "/api/js"), "java": ("/javadoc", "/docs/java", "/apidocs"), "go": ("/godoc", "/docs/go"),
}


def discovered(url: Column, language: str, versions: tuple[str, ...] = ("latest", "stable")) -> Column:
    """Candidate documentation URLs of a site: common folders, the language's, and both below each version; each once."""
    base = F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)
    own = (*DOC_FOLDERS, *LANGUAGE_FOLDERS.get(language, ()))
    return F.array_distinct(_below(base, (*own, *(f"/{v}{p}" for v in versions for p in ("", *LANGUAGE_FOLDERS.get(language, ()))))))
