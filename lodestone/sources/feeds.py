"""Registry, advisory and release documents to flat rows. Fetching is not done here: rows hold the replies' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.versions import severity

# fixed values: where registries keep the latest version, and their address templates
LATEST_PATHS = {"cargo": "$.crate.max_stable_version", "npm": "$['dist-tags'].latest", "pypi": "$.info.version", "pub": "$.latest.version", "go": "$.Version", "maven": "$.response.docs[0].latestVersion"}
ADDRESSES = {
    "cargo": "https://crates.io/api/v1/crates/%s", "npm": "https://registry.npmjs.org/%s", "pypi": "https://pypi.org/pypi/%s/json",
    "pub": "https://pub.dev/api/packages/%s", "go": "https://proxy.golang.org/%s/@latest", "maven": "https://search.maven.org/solrsearch/select?q=%s",
}
OSV = (
    "id string, summary string, details string, aliases array<string>, published string, severity array<struct<type:string,score:string>>, "
    "database_specific struct<severity:string>, references array<struct<url:string>>, "
    "affected array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>"
)
RELEASES = "array<struct<tag_name:string,name:string,body:string,published_at:string,prerelease:boolean,draft:boolean>>"


def latest_version(registry: Column, reply: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, path in LATEST_PATHS.items():
        out = F.when(registry == name, F.get_json_object(reply, path)).otherwise(out)
    return out


def address(registry: Column, package: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, template in ADDRESSES.items():
        out = F.when(registry == name, F.replace(F.lit(template), F.lit("%s"), package)).otherwise(out)
    return out


def osv(replies: DataFrame, column: str = "reply") -> DataFrame:
    """One row per advisory: id, cve, package, severity, affected_versions, fixed_versions, references."""
    v = F.from_json(column, OSV)
    rows = replies.select(v.alias("v")).where("v.id is not null")
    fixed = F.flatten(F.transform(F.flatten(F.transform("v.affected", lambda a: F.coalesce(a["ranges"], F.array()))), lambda r: F.transform(r["events"], lambda e: e["fixed"])))
    return rows.select(
        "v.id",
        F.get(F.filter("v.aliases", lambda a: a.startswith("CVE-")), 0).alias("cve"),
        F.get("v.affected", 0)["package"]["name"].alias("package"),
        severity(F.coalesce("v.database_specific.severity", F.get("v.severity", 0)["score"], F.lit(""))).alias("severity"),
        F.array_distinct(F.flatten(F.transform("v.affected", lambda a: F.coalesce(a["versions"], F.array())))).alias("affected_versions"),
        F.array_distinct(F.filter(fixed, lambda x: x.isNotNull())).alias("fixed_versions"),
        F.transform("v.references", lambda r: r["url"]).alias("references"),
    )


def releases(replies: DataFrame, column: str = "reply") -> DataFrame:
    """language, version, release_date, is_stable, body from rows of (language, reply): a JSON array of releases."""
    rows = replies.select("language", F.explode(F.from_json(column, RELEASES)).alias("r"))
    version = F.regexp_replace("r.tag_name", "^[vV]", "")
    return rows.where("r.tag_name is not null and not coalesce(r.draft, false)").select(
        "language", version.alias("version"), F.try_to_timestamp("r.published_at").alias("release_date"), (~F.coalesce("r.prerelease", F.lit(False))).alias("is_stable"), F.coalesce("r.body", F.lit("")).alias("body")
    )


def rss_titles(replies: DataFrame, column: str = "reply") -> DataFrame:
    """title, version of feed titles that name a version."""
    rows = replies.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<title>\s*(.*?)\s*</title>"), F.lit(1))).alias("title"))
    version = F.regexp_extract("title", r"v?(\d+\.\d+(?:\.\d+)?)", 1)
    return rows.where(version != "").select("title", version.alias("version"))


def robots(replies: DataFrame, column: str = "reply") -> DataFrame:
    """kind, value of the sitemap, allow and disallow lines; everything after the first colon is the value."""
    rows = replies.select(F.explode(F.split(column, "\r?\n")).alias("line"))
    kind = F.lower(F.trim(F.regexp_extract("line", r"^([^:#]+):", 1)))
    return rows.select(kind.alias("kind"), F.trim(F.regexp_extract("line", r"^[^:]+:\s*([^#]*)", 1)).alias("value")).where("kind in ('sitemap', 'allow', 'disallow')")


def sitemap(replies: DataFrame, column: str = "reply") -> DataFrame:
    return replies.select(F.explode(F.regexp_extract_all(column, F.lit(r"<loc>\s*([^<]*?)\s*</loc>"), F.lit(1))).alias("url")).distinct()


# fixed values: names of ecosystems, and the shapes of further replies
ECOSYSTEMS = (
    (("npm", "javascript", "typescript", "node"), "npm", "npm"), (("pip", "python"), "PyPI", "pip"), (("cargo", "rust"), "crates.io", "cargo"), (("maven", "java"), "Maven", "maven"),
    (("go",), "Go", "go"), (("pub", "dart", "flutter"), "Pub", "pub"),
)
GITHUB_ADVISORY = "ghsa_id string, cve_id string, summary string, description string, severity string, cvss struct<score:double>, published_at string, updated_at string"
RUSTSEC = "id string, title string, description string"
GRAPHQL = "data struct<repository:struct<releases:struct<nodes:array<struct<tagName:string,name:string,description:string,publishedAt:string,isPrerelease:boolean>>>>>"
ANALYSIS = (
    "version string, features array<struct<name:string,description:string,category:string,impact:string>>, breaking_changes array<struct<description:string>>, deprecations array<struct<feature:string>>"
)
REPOSITORY = "full_name string, description string, stargazers_count long, forks_count long, language string"
VERSION_PATHS = {"npm": "versions", "pypi": "releases"}  # objects whose keys are versions


def ecosystem(name: Column, form: str = "osv") -> Column:
    """An ecosystem's name at OSV or at GitHub; others stay."""
    lower, out = F.lower(name), name
    for names, osv_name, github_name in ECOSYSTEMS:
        out = F.when(lower.isin(*names), F.lit(osv_name if form == "osv" else github_name)).otherwise(out)
    return out


def github_advisories(replies: DataFrame, column: str = "reply") -> DataFrame:
    """ecosystem, id, cve, summary, severity, cvss, published, references from rows of (ecosystem, reply): one advisory each."""
    v = replies.select("ecosystem", F.from_json(column, GITHUB_ADVISORY).alias("v")).where("v is not null and v.ghsa_id is not null")
    return v.select(
        "ecosystem", F.col("v.ghsa_id").alias("id"), F.col("v.cve_id").alias("cve"), F.coalesce("v.summary", F.lit("")).alias("summary"), severity(F.coalesce("v.severity", F.lit(""))).alias("severity"),
        F.col("v.cvss.score").alias("cvss"), F.try_to_timestamp("v.published_at").alias("published"), F.array(F.concat(F.lit("https://github.com/advisories/"), "v.ghsa_id")).alias("references"),
    )


def rustsec_advisories(replies: DataFrame, column: str = "reply") -> DataFrame:
    """The same columns from rows of (package, reply); these advisories name no severity, which counts as medium."""
    v = replies.select("package", F.from_json(column, RUSTSEC).alias("v")).where("v.id is not null")
    none = F.lit(None)
    return v.select(
        F.lit("cargo").alias("ecosystem"), "v.id", none.cast("string").alias("cve"), F.coalesce("v.title", F.lit("")).alias("summary"), F.lit("MEDIUM").alias("severity"), none.cast("double").alias("cvss"),
        none.cast("timestamp").alias("published"), F.array(F.concat(F.lit("https://rustsec.org/advisories/"), "package")).alias("references"),
    )


def graphql_releases(replies: DataFrame, column: str = "reply") -> DataFrame:
    """What ``releases`` gives, from replies of a GraphQL endpoint."""
    rows = replies.select("language", F.explode(F.from_json(column, GRAPHQL)["data"]["repository"]["releases"]["nodes"]).alias("r"))
    return rows.where("r.tagName is not null").select(
        "language", F.regexp_replace("r.tagName", "^[vV]", "").alias("version"), F.try_to_timestamp("r.publishedAt").alias("release_date"), (~F.coalesce("r.isPrerelease", F.lit(False))).alias("is_stable"),
        F.coalesce("r.description", F.lit("")).alias("body"),
    )


def web_releases(pages: DataFrame, column: str = "html") -> DataFrame:
    """language, version of a web page's headings that name a version, each once."""
    heads = F.regexp_extract_all(column, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    rows = pages.select("language", F.explode(heads).alias("h"))
    version = F.regexp_extract(F.regexp_replace("h", "<[^>]*>", ""), r"(\d+\.\d+(?:\.\d+)?)", 1)
    return rows.select("language", version.alias("version")).where("version <> ''").distinct()


def version_list(replies: DataFrame, column: str = "reply", *, stable_only: bool = True, limit: int = 50) -> DataFrame:
    """registry, version: the versions that an npm or PyPI reply lists, at most ``limit`` of each reply, newest names first."""
    keys = F.lit(None).cast("array<string>")
    for name, path in VERSION_PATHS.items():
        keys = F.when(F.col("registry") == name, F.json_object_keys(F.get_json_object(column, f"$.{path}"))).otherwise(keys)
    good = F.filter(keys, lambda v: v.rlike(r"^\d+\.\d+") & ~F.lower(v).rlike("alpha|beta|rc|dev")) if stable_only else keys
    newest = F.slice(F.reverse(F.array_sort(good)), 1, limit)
    return replies.select("registry", F.explode(newest).alias("version"))


def package_document(replies: DataFrame, column: str = "reply") -> DataFrame:
    """registry, name, version, description, homepage, license of a registry's reply: what a page about the package shows."""
    paths = {  # fixed values: places in the replies
        "npm": ("$.name", "$['dist-tags'].latest", "$.description", "$.homepage", "$.license"),
        "pypi": ("$.info.name", "$.info.version", "$.info.summary", "$.info.home_page", "$.info.license"),
        "cargo": ("$.crate.name", "$.crate.max_version", "$.crate.description", "$.crate.homepage", "$.crate.license"),
        "pub": ("$.name", "$.latest.version", "$.latest.pubspec.description", "$.latest.pubspec.homepage", "$.latest.pubspec.license"),
    }
    out = []
    for k, name in enumerate(("name", "version", "description", "homepage", "license")):
        own = F.lit(None).cast("string")
        for registry, at in paths.items():
            own = F.when(F.col("registry") == registry, F.get_json_object(column, at[k])).otherwise(own)
        out.append(own.alias(name))
    return replies.select("registry", *out)


def repositories(replies: DataFrame, column: str = "reply", limit: int = 5) -> DataFrame:
    """name, description, stars, forks, language of a repository search's items, the first ``limit`` of each reply."""
    items = F.slice(F.from_json(column, f"items array<struct<{REPOSITORY.replace(' ', ':').replace(',:', ',')}>>")["items"], 1, limit)
    return replies.select(F.explode(items).alias("r")).select(F.col("r.full_name").alias("name"), "r.description", F.coalesce("r.stargazers_count", F.lit(0)).alias("stars"), F.coalesce("r.forks_count", F.lit(0)).alias("forks"), "r.language")


def typescript_info(reply: Column) -> Column:
    """struct of types (declared file), native (written in it or with types of its own) and category."""
    types = F.coalesce(F.get_json_object(reply, "$.types"), F.get_json_object(reply, "$.typings"))
    words = F.lower(F.coalesce(F.get_json_object(reply, "$.keywords"), F.lit("")))
    kind = F.when(F.contains(words, F.lit("react")) | F.contains(words, F.lit("vue")), "frontend").when(F.contains(words, F.lit("server")) | F.contains(words, F.lit("http")), "backend").when(F.contains(words, F.lit("cli")), "tool").otherwise("library")
    native = types.isNotNull() | F.get_json_object(reply, "$.devDependencies.typescript").isNotNull()
    return F.struct(types.alias("types"), native.alias("native"), kind.alias("category"))


def analyses(replies: DataFrame, column: str = "reply") -> DataFrame:
    """language, version, kind, name, category, impact, tags from rows of (language, reply): an analysis of a version as JSON.

    Missing categories are Other, missing impacts Medium; tags are both in lower case.
    """
    v = replies.select("language", F.from_json(column, ANALYSIS).alias("v")).where("v.version is not null")
    item = lambda kind, name, category, impact: F.struct(F.lit(kind).alias("kind"), name.alias("name"), category.alias("category"), impact.alias("impact"))
    none = F.array().cast("array<struct<kind:string,name:string,category:string,impact:string>>")
    parts = (
        F.transform("v.features", lambda f: item("feature", f["name"], F.coalesce(f["category"], F.lit("Other")), F.coalesce(f["impact"], F.lit("Medium")))),
        F.transform("v.breaking_changes", lambda b: item("breaking", b["description"], F.lit("Other"), F.lit("High"))),
        F.transform("v.deprecations", lambda d: item("deprecation", d["feature"], F.lit("Other"), F.lit("Medium"))),
    )
    rows = v.select("language", "v.version", F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("i"))
    return rows.select("language", "version", "i.*", F.array(F.lower("i.category"), F.lower("i.impact")).alias("tags"))
