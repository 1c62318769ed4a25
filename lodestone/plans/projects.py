"""Queries of manifests, registry and advisory replies, policies, project profiles and crawls, over texts that Spark and the SQL derive
alike from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import html
from lodestone.operators import crawl, packages, policies, profile, search
from lodestone.plans.base import query, table
from lodestone.sources import feeds, manifests
from lodestone.streaming import windows

# one manifest for each supplier, of the kind that its key chooses; ~ is a line end, # the key
MANIFESTS = (
    ("package.json", '{"dependencies": {"alpha": "^1.#.0"}, "devDependencies": {"beta": "~2.0.#"}}'.replace("~2", "`2")),
    ("requirements.txt", "alpha==1.#.0~// comment~beta>=2.0.#~-e x~".replace("//", "#")),
    ("go.mod", "module m~require (~\talpha v1.#.0~\tbeta v2.0.# // indirect~)~"),
    ("Cargo.toml", '[dependencies]~alpha = "1.#.0"~[dev-dependencies]~beta = {{ version = "2.0.#" }}~'.replace("{{", "{").replace("}}", "}")),
    ("pyproject.toml", '[project]~dependencies = ["alpha==1.#.0", "beta>=2.0.#"]~'),
    ("pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>alpha</artifactId><version>1.#.0</version></dependency><dependency><groupId>g</groupId><artifactId>beta</artifactId><version>2.0.#</version><scope>test</scope></dependency></dependencies></project>"),
    ("pubspec.yaml", "name: x~dependencies:~  alpha: ^1.#.0~dev_dependencies:~  beta: 2.0.#~"),
)


def _filled(template: str) -> F.Column:
    parts = template.replace("# comment", "\x01").replace("~", "\n").replace("`", "~").split("#")
    out = [F.lit(parts[0].replace("\x01", "# comment"))]
    for p in parts[1:]:
        out += [F.col("s_suppkey").cast("string"), F.lit(p.replace("\x01", "# comment"))]
    return F.concat(*out)


def _manifests(spark, sf_dir):
    kind = F.col("s_suppkey") % len(MANIFESTS)
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, template) in enumerate(MANIFESTS):
        path = F.when(kind == k, F.concat(F.lit("p"), "s_suppkey", F.lit("/" + name))).otherwise(path)
        content = F.when(kind == k, _filled(template)).otherwise(content)
    return table(spark, sf_dir, "supplier").select("s_suppkey", path.alias("path"), content.alias("content"))


_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in MANIFESTS) + "][s_suppkey % 7 + 1]"


@query(f"""SELECT 'p' || s_suppkey || '/' || {_NAMES} AS path, CASE WHEN s_suppkey % 7 = 5 THEN 'g:alpha' ELSE 'alpha' END AS name, '1.' || s_suppkey || '.0' AS version, CASE WHEN s_suppkey % 7 = 5 THEN 'compile' ELSE 'direct' END AS kind, NULL::VARCHAR AS error FROM supplier
UNION ALL SELECT 'p' || s_suppkey || '/' || {_NAMES}, CASE WHEN s_suppkey % 7 = 5 THEN 'g:beta' ELSE 'beta' END, '2.0.' || s_suppkey, ['dev', 'direct', 'direct', 'dev', 'direct', 'test', 'dev'][s_suppkey % 7 + 1], NULL FROM supplier""")
def manifest_dependencies(spark, sf_dir):
    return manifests.dependencies(_manifests(spark, sf_dir))


@query(f"""SELECT {_NAMES} AS language, 2 * count(*) AS total, CASE WHEN any_value(s_suppkey % 7) IN (0, 3, 5, 6) THEN count(*) ELSE 0 END AS dev FROM supplier GROUP BY 1""")
def manifest_counts(spark, sf_dir):
    found = manifests.dependencies(_manifests(spark, sf_dir)).withColumn("language", profile.file_name(F.col("path")))
    return packages.manifest_counts(found)


_REPLIES = {
    "cargo": ('{"crate": {"name": "n#", "max_version": "1.#.0", "max_stable_version": "1.#.0", "description": "d", "homepage": "h", "license": "MIT"}}'),
    "npm": '{"name": "n#", "dist-tags": {"latest": "1.#.0"}, "versions": {"1.#.0": {}, "1.#.1-beta": {}, "0.9": {}}, "description": "d", "homepage": "h", "license": "MIT", "types": "index.d.ts", "keywords": ["react"]}',
    "pypi": '{"info": {"name": "n#", "version": "1.#.0", "summary": "d", "home_page": "h", "license": "MIT"}, "releases": {"1.#.0": [], "2.0rc1": [], "0.9": []}}',
    "pub": '{"name": "n#", "latest": {"version": "1.#.0", "pubspec": {"description": "d", "homepage": "h", "license": "MIT"}}}',
    "go": '{"Version": "1.#.0"}',
    "maven": '{"response": {"docs": [{"latestVersion": "1.#.0"}]}}',
}
_REGISTRIES = "['cargo', 'npm', 'pypi', 'pub', 'go', 'maven'][s_suppkey % 6 + 1]"


def _replies(spark, sf_dir):
    names = list(_REPLIES)
    registry, reply = F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 6 + 1).cast("int")), F.lit(None).cast("string")
    for k, name in enumerate(names):
        reply = F.when(F.col("s_suppkey") % 6 == k, _filled(_REPLIES[name])).otherwise(reply)
    return table(spark, sf_dir, "supplier").select("s_suppkey", registry.alias("registry"), reply.alias("reply"))


_ADDRESS = "CASE s_suppkey % 6 WHEN 0 THEN 'https://crates.io/api/v1/crates/n' || s_suppkey WHEN 1 THEN 'https://registry.npmjs.org/n' || s_suppkey WHEN 2 THEN 'https://pypi.org/pypi/n' || s_suppkey || '/json' WHEN 3 THEN 'https://pub.dev/api/packages/n' || s_suppkey WHEN 4 THEN 'https://proxy.golang.org/n' || s_suppkey || '/@latest' ELSE 'https://search.maven.org/solrsearch/select?q=n' || s_suppkey END"


@query(f"SELECT s_suppkey, {_REGISTRIES} AS registry, '1.' || s_suppkey || '.0' AS version, {_ADDRESS} AS address FROM supplier")
def registry_versions(spark, sf_dir):
    name = F.concat(F.lit("n"), "s_suppkey")
    return _replies(spark, sf_dir).select("s_suppkey", "registry", feeds.latest_version(F.col("registry"), F.col("reply")).alias("version"), feeds.address(F.col("registry"), name).alias("address"))


@query(f"SELECT {_REGISTRIES} AS registry, unnest(['1.' || s_suppkey || '.0', '0.9']) AS version FROM supplier WHERE s_suppkey % 6 IN (1, 2)")
def version_lists(spark, sf_dir):
    return feeds.version_list(_replies(spark, sf_dir))


@query(f"SELECT {_REGISTRIES} AS registry, CASE WHEN s_suppkey % 6 < 4 THEN 'n' || s_suppkey END AS name, CASE WHEN s_suppkey % 6 < 4 THEN '1.' || s_suppkey || '.0' END AS version, CASE WHEN s_suppkey % 6 < 4 THEN 'd' END AS description, CASE WHEN s_suppkey % 6 < 4 THEN 'h' END AS homepage, CASE WHEN s_suppkey % 6 < 4 THEN 'MIT' END AS license FROM supplier")
def package_documents(spark, sf_dir):
    return feeds.package_document(_replies(spark, sf_dir))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 6 = 1 THEN 'index.d.ts' END AS types, s_suppkey % 6 = 1 AS native, CASE WHEN s_suppkey % 6 = 1 THEN 'frontend' ELSE 'library' END AS category FROM supplier")
def typescript_facts(spark, sf_dir):
    return _replies(spark, sf_dir).select("s_suppkey", feeds.typescript_info(F.col("reply")).alias("t")).select("s_suppkey", "t.*")


_VULN = '{"id": "OSV-#", "aliases": ["GHSA-#", "CVE-2024-#"], "database_specific": {"severity": "moderate"}, "affected": [{"package": {"name": "n#", "ecosystem": "npm"}, "versions": ["1.0", "1.1", "1.0"], "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.#"}]}]}], "references": [{"url": "http://x/#"}]}'
_OPEN = '{"id": "OSV-#", "severity": [{"type": "CVSS", "score": "high"}], "affected": [{"package": {"name": "n#"}}]}'


def _advisories(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, _filled(_VULN)).otherwise(_filled(_OPEN)).alias("reply"))


@query("""SELECT 'OSV-' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'CVE-2024-' || s_suppkey END AS cve, 'n' || s_suppkey AS package, CASE WHEN s_suppkey % 2 = 0 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  CASE WHEN s_suppkey % 2 = 0 THEN '1.0 1.1' ELSE '' END AS affected, CASE WHEN s_suppkey % 2 = 0 THEN '1.' || s_suppkey ELSE '' END AS fixed FROM supplier""")
def osv_advisories(spark, sf_dir):
    found = feeds.osv(_advisories(spark, sf_dir))
    return found.select("id", "cve", "package", "severity", F.array_join("affected_versions", " ").alias("affected"), F.array_join("fixed_versions", " ").alias("fixed"))


@query("SELECT 'OSV-' || s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 1")
def advisories_without_fix(spark, sf_dir):
    return packages.without_fix(feeds.osv(_advisories(spark, sf_dir))).select("id")


@query("""SELECT 'GHSA-' || s_suppkey AS id, 'CVE-' || s_suppkey AS cve, 'CRITICAL' AS severity, 9.5::DOUBLE AS cvss, TIMESTAMP '2024-01-02 03:04:05' AS published, 'https://github.com/advisories/GHSA-' || s_suppkey AS reference, CASE WHEN s_suppkey % 2 = 0 THEN 'PyPI' ELSE 'other' END AS ecosystem FROM supplier
UNION ALL SELECT 'RUSTSEC-' || s_suppkey, NULL, 'MEDIUM', NULL, NULL, 'https://rustsec.org/advisories/n' || s_suppkey, 'crates.io' FROM supplier""")
def advisory_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    github = rows.select(F.when(F.col("s_suppkey") % 2 == 0, "Python").otherwise("other").alias("ecosystem"), _filled('{"ghsa_id": "GHSA-#", "cve_id": "CVE-#", "severity": "critical", "cvss": {"score": 9.5}, "published_at": "2024-01-02T03:04:05Z"}').alias("reply"))
    rust = rows.select(F.concat(F.lit("n"), "s_suppkey").alias("package"), _filled('{"id": "RUSTSEC-#", "title": "t"}').alias("reply"))
    both = feeds.github_advisories(github).unionByName(feeds.rustsec_advisories(rust))
    return both.select("id", "cve", "severity", "cvss", F.col("published").cast("timestamp_ntz").alias("published"), F.get("references", 0).alias("reference"), feeds.ecosystem(F.col("ecosystem")).alias("ecosystem"))


@query("""SELECT 'rust' AS language, '1.' || s_suppkey || '.0' AS version, TIMESTAMP '2024-01-02 03:04:05' AS release_date, s_suppkey % 2 = 0 AS is_stable, 'body ' || s_suppkey AS body FROM supplier
UNION ALL SELECT 'go', '2.' || s_suppkey, TIMESTAMP '2024-01-02 03:04:05', s_suppkey % 2 = 0, 'body ' || s_suppkey FROM supplier""")
def release_sources(spark, sf_dir):
    pre = F.when(F.col("s_suppkey") % 2 == 0, "false").otherwise("true")
    tail = lambda a, b: F.concat(_filled(a), pre, F.lit(b))
    rows = table(spark, sf_dir, "supplier")
    rest = rows.select(F.lit("rust").alias("language"), tail('[{"tag_name": "v1.#.0", "body": "body #", "published_at": "2024-01-02T03:04:05Z", "prerelease": ', '}, {"tag_name": "v9", "draft": true}]').alias("reply"))
    graph = rows.select(F.lit("go").alias("language"), tail('{"data": {"repository": {"releases": {"nodes": [{"tagName": "v2.#", "description": "body #", "publishedAt": "2024-01-02T03:04:05Z", "isPrerelease": ', '}]}}}}').alias("reply"))
    return feeds.releases(rest).unionByName(feeds.graphql_releases(graph)).withColumn("release_date", F.col("release_date").cast("timestamp_ntz"))


@query("""SELECT DISTINCT 'rust' AS language, '1.' || s_suppkey || '.2' AS version FROM supplier""")
def web_releases(spark, sf_dir):
    page = table(spark, sf_dir, "supplier").select(F.lit("rust").alias("language"), _filled("<h2>Rust <b>1.#.2</b></h2><p>3.4.5</p><h3>again 1.#.2</h3><h2>no</h2>").alias("html"))
    return feeds.web_releases(page)


@query("""SELECT 'Release 1.' || s_suppkey AS title, '1.' || s_suppkey AS version, CASE WHEN s_suppkey % 2 = 0 THEN 'http://a/s.xml' ELSE '/x' END AS robots, 'http://a/' || s_suppkey AS url FROM supplier""")
def feed_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    titles = feeds.rss_titles(rows.select(_filled("<rss><title>Blog</title><item><title> Release 1.# </title></item></rss>").alias("reply")))
    lines = feeds.robots(rows.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lit("Sitemap: http://a/s.xml \n")).otherwise(F.lit("# c\nDisallow: /x\n")).alias("reply")))
    urls = feeds.sitemap(rows.select(_filled("<urlset><url><loc> http://a/# </loc></url></urlset>").alias("reply")))
    kinds = lines.groupBy("value").agg(F.count("*").alias("n"))
    key = lambda c: F.regexp_extract(c, r"(\d+)$", 1).cast("long")
    joined = titles.withColumn("k", key(F.col("version"))).join(urls.withColumn("k", key(F.col("url"))), "k")
    return joined.join(kinds, F.when(F.col("k") % 2 == 0, "http://a/s.xml").otherwise("/x") == F.col("value")).select("title", "version", F.col("value").alias("robots"), "url")


@query("""SELECT 'rust' AS language, '1.' || s_suppkey AS version, unnest(['feature', 'feature', 'breaking']) AS kind, unnest(['f' || s_suppkey, 'g', 'removed']) AS name, unnest(['Async', 'Other', 'Other']) AS category, unnest(['High', 'Medium', 'High']) AS impact, unnest(['async,high', 'other,medium', 'other,high']) AS tags FROM supplier""")
def version_analyses(spark, sf_dir):
    reply = _filled('{"version": "1.#", "features": [{"name": "f#", "category": "Async", "impact": "High"}, {"name": "g"}], "breaking_changes": [{"description": "removed"}]}')
    found = feeds.analyses(table(spark, sf_dir, "supplier").select(F.lit("rust").alias("language"), reply.alias("reply")))
    return found.withColumn("tags", F.array_join("tags", ","))


@query("""SELECT 'o/r' || s_suppkey AS name, 'd' AS description, s_suppkey::BIGINT AS stars, 0::BIGINT AS forks, 'Go' AS language FROM supplier UNION ALL SELECT 'o/x', NULL, 0, 0, NULL FROM supplier, range(4)""")
def repository_search(spark, sf_dir):
    more = ', {"full_name": "o/x"}' * 6
    reply = _filled('{"items": [{"full_name": "o/r#", "description": "d", "stargazers_count": #, "language": "Go"}' + more + "]}")
    return feeds.repositories(table(spark, sf_dir, "supplier").select(reply.alias("reply")))


def _profiles(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.when(key % 3 == 0, "rust").when(key % 3 == 1, "python").otherwise("go").alias("language"),
        (key % 10 / 10.0).alias("score"),
        F.when(key % 2 == 0, F.array(F.lit("Cargo.toml"), F.lit("src/main.rs"))).otherwise(F.array().cast("array<string>")).alias("project_files"),
        F.array(F.struct(F.lit("cargo").alias("name"), (key % 4 == 0).alias("available"))).alias("cli_tools"),
        F.when(key % 5 == 0, F.array(F.lit("tokio"))).otherwise(F.array().cast("array<string>")).alias("detected_features"),
    )


_S, _T, _P = "(s_suppkey % 10 / 10.0)", "(s_suppkey % 4 = 0)", "(s_suppkey % 2 = 0)"


@query(f"""SELECT s_suppkey, {_S} >= 0.5 AS project_based, s_suppkey % 3 = 0 AS user_preference, {_T} AS tool_availability, {_S} >= 0.5 OR ({_P} AND {_T}) AS adaptive, {_P} OR {_T} AS aggressive,
  {_S} >= 0.7 AND {_P} AND {_T} AS conservative, {_S} >= 0.5 AND ({_P} OR {_T}) AS intelligent, s_suppkey % 5 = 0 AND {_P} AS conditional,
  ({_S} > 0.3 AND {_P}) OR {_T} AS expression, NOT ({_S} >= 0.5) <> (s_suppkey % 3 = 0) AS tree FROM supplier""")
def registration_policies(spark, sf_dir):
    options = {"user_preference": {"languages": ("rust",)}, "conditional": {"conditions": (("framework_detected", "tokio"), ("min_project_files", 1))}}
    names = ("project_based", "user_preference", "tool_availability", "adaptive", "aggressive", "conservative", "intelligent", "conditional")
    tree = {"op": "xor", "items": [{"op": "not", "items": [{"field": "score", "compare": ">=", "value": 0.5}]}, {"field": "language", "compare": "==", "value": "rust"}]}
    return _profiles(spark, sf_dir).select("s_suppkey", *[policies.policy(n, **options.get(n, {})).alias(n) for n in names],
        policies.predicate('(score > 0.3 && has_file("Cargo.toml")) || has_cli("cargo")').alias("expression"), policies.parsed_condition(tree).alias("tree"))


@query(f"SELECT s_suppkey, language FROM (SELECT s_suppkey, {_S} AS s, CASE s_suppkey % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' ELSE 'go' END AS language FROM supplier) WHERE s >= 0.5")
def registration_plan(spark, sf_dir):
    return policies.plan(_profiles(spark, sf_dir), "project_based").select("s_suppkey", "language")


@query("""SELECT n_nationkey, 't' || n_nationkey AS tool, (n_nationkey % 2 = 0 AND n_nationkey % 3 = 0) AS chosen, CASE WHEN n_nationkey % 2 = 1 THEN 'not installed' WHEN n_nationkey % 3 <> 0 THEN 'no wanted feature' ELSE 'feature' END AS reason FROM nation""")
def tool_plan(spark, sf_dir):
    key = F.col("n_nationkey")
    tools = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("t"), "n_nationkey").alias("tool"), (key % 2 == 0).alias("available"), F.array(F.when(key % 3 == 0, "build").otherwise("test")).alias("tags"))
    return policies.tool_plan(tools, "feature_based", ("build",)).drop("available", "tags")


@query("""SELECT CASE WHEN n_regionkey = 0 THEN 'general' ELSE r_name END AS category, count(*) FILTER (n_nationkey % 2 = 0) AS installed, string_agg(n_name || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ' (missing)' END, ', ' ORDER BY n_name || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ' (missing)' END) AS tools FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def tool_inventory(spark, sf_dir):
    tools = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return policies.inventory_report(tools.select(F.col("n_name").alias("tool"), (F.col("n_nationkey") % 2 == 0).alias("available"), F.when(F.col("n_regionkey") > 0, F.col("r_name")).otherwise("").alias("category")))


@query("SELECT 't' || n_nationkey AS tool, n_regionkey FROM nation WHERE n_nationkey % 3 <> 0")
def missing_tools(spark, sf_dir):
    tools = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), "n_nationkey").alias("tool"), "n_regionkey", "n_nationkey")
    return policies.missing_tools(tools.select("tool", "n_regionkey"), tools.where("n_nationkey % 3 = 0"))


@query("""SELECT user_id, count(*) AS calls, round(100 * (0.5 * avg((event_type <> 'refund')::INT) + 0.3 * avg((event_id % 2)::DOUBLE) + 0.2 * least(5000 / avg(value * 100), 1.0)), 6) AS score FROM events GROUP BY user_id""")
def registry_statistics(spark, sf_dir):
    found = policies.registry_statistics(table(spark, sf_dir, "events"), ["user_id"], F.col("event_type") != "refund", F.col("event_id") % 2, F.col("value") * 100)
    return found.withColumn("score", F.round("score", 6))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'tokio' WHEN 1 THEN '' ELSE '' END AS frameworks, CASE s_suppkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END + (s_suppkey > 50)::INT + (s_suppkey % 2)::INT AS advice FROM supplier""")
def project_advice(spark, sf_dir):
    rows = _profiles(spark, sf_dir).withColumn("f", policies.frameworks(F.col("language"), F.lit("needs tokio")))
    advice = policies.project_advice(F.col("language"), F.array(F.lit("Cargo.toml")), F.col("f"), F.col("s_suppkey"), F.col("s_suppkey") % 2 + 1)
    return rows.select("s_suppkey", F.array_join("f", ",").alias("frameworks"), F.size(advice).alias("advice"))


_EXT = "['rs', 'py', 'js', 'md', 'RS'][p_partkey % 5 + 1]"


@query(f"""WITH f AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CASE p_partkey % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' WHEN 4 THEN 'rust' END END AS language, 1 AS files, 1 AS weight FROM part UNION ALL SELECT 'rust', 0, 10 UNION ALL SELECT 'javascript', 0, 10),
s AS (SELECT language, sum(files)::BIGINT AS files, sum(weight)::BIGINT AS weight FROM f WHERE language IS NOT NULL GROUP BY language)
SELECT language, files, weight, round(weight / sum(weight) OVER (), 6) AS share FROM s""")
def project_languages(spark, sf_dir):
    name = F.concat(F.when(F.col("p_partkey") % 7 == 0, "node_modules/").otherwise("src/"), F.lit("f"), "p_partkey", F.lit("."), F.element_at(F.array(*map(F.lit, ("rs", "py", "js", "md", "RS"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    files = table(spark, sf_dir, "part").select(name.alias("path"))
    marks = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "Cargo.toml").otherwise("package.json").alias("path"))
    found = profile.languages(files.union(marks))
    return found.withColumn("share", F.round("share", 6))


@query(f"""SELECT p_partkey, 'f.' || p_partkey AS stem, lower({_EXT}) AS extension, 'src/a' AS folder, CASE p_partkey % 5 WHEN 3 THEN 'documentation' ELSE 'source' END AS type FROM part""")
def file_parts(spark, sf_dir):
    path = F.concat(F.lit("src/a/f."), "p_partkey", F.lit("."), F.element_at(F.array(*map(F.lit, ("rs", "py", "js", "md", "RS"))), (F.col("p_partkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", path.alias("p")).select("p_partkey", profile.file_stem(F.col("p")).alias("stem"), profile.file_extension(F.col("p")).alias("extension"), profile.folder(F.col("p")).alias("folder"), profile.file_type(F.col("p")).alias("type"))


@query("""SELECT s_suppkey, round(least(0.6 * (s_suppkey % 4) / 3 + 0.4 * CASE WHEN s_suppkey % 2 = 0 THEN 0.5 ELSE 0 END, 1.0), 6) AS score FROM supplier""")
def language_scores(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(profile.language_score(key % 4, F.lit(3), F.when(key % 2 == 0, 1).otherwise(0), F.when(key % 2 == 0, 2).otherwise(0)), 6).alias("score"))


@query("""WITH RECURSIVE l AS (SELECT page_id AS page, page_id * 2 + 1 AS link, page_id % 7 AS priority FROM pages UNION ALL SELECT page_id, page_id * 3 + 2, page_id % 5 FROM pages UNION ALL SELECT page_id, page_id // 2, 1 FROM pages),
v AS (SELECT 0::BIGINT AS page, 0 AS depth UNION SELECT link, depth + 1 FROM v JOIN l ON v.page = l.page WHERE depth < 3)
SELECT page, min(depth) AS depth FROM v GROUP BY page""")
def crawled_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"))
    p = F.col("page")
    links = pages.select("page", F.explode(F.array(F.struct((p * 2 + 1).alias("link"), (p % 7).cast("int").alias("priority")), F.struct((p * 3 + 2).alias("link"), (p % 5).cast("int").alias("priority")), F.struct(F.floor(p / 2).alias("link"), F.lit(1).alias("priority")))).alias("l"))
    links = links.select("page", "l.*", F.lit(1.0).alias("relevance"))
    seeds = pages.where("page = 0").withColumn("priority", F.lit(5))
    return crawl.crawl(links, seeds, max_depth=3, max_pages=1_000_000).select("page", "depth")


@query("""WITH l AS (SELECT user_id AS page, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id)
SELECT page, count(*) AS near, n FROM events JOIN l ON page = user_id WHERE ts >= last - INTERVAL 5 MINUTE GROUP BY page, n HAVING n > 70 OR count(*) > 2""")
def crawl_loops(spark, sf_dir):
    return crawl.loops(table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), "ts"), most=70)


@query("""SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, n_chars / 20000.0 AS score FROM documents) WHERE score >= 0.1 ORDER BY score DESC, doc_id LIMIT 10""")
def reranked(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 20000.0).alias("score"))
    return search.rerank(hits, 0.1).select("doc_id", F.round("score", 6).alias("score"))


@query("""SELECT count(*) AS rows, sum(doc_id)::BIGINT AS ids, count(DISTINCT lang) AS prefixes FROM documents""")
def stored_snapshot(spark, sf_dir):
    """A partitioned snapshot, written to the shared folder and read back."""
    from lodestone.operators import store
    from lodestone.runtime import scratch_path

    path = scratch_path(spark, "snapshot")
    store.snapshot(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, ("lang",))
    return store.load(spark, path).agg(F.count("*").alias("rows"), F.sum("doc_id").alias("ids"), F.count_distinct("lang").alias("prefixes"))


@query("""SELECT 'rust' AS language, p_brand AS version, p_size AS features, 1 AS breaking, CASE WHEN p_size > 25 THEN 'big' ELSE '' END AS high_impact FROM (SELECT p_brand, max(p_size) AS p_size FROM part GROUP BY p_brand) WHERE p_brand >= 'Brand#2'""")
def release_timeline(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("version")).agg(F.max("p_size").alias("n"))
    feature = F.struct(F.when(F.col("n") > 25, "big").otherwise("small").alias("name"), F.when(F.col("n") > 25, "High").otherwise("Low").alias("impact"))
    rows = rows.select(F.lit("rust").alias("language"), "version", F.lit("2024-01-01").cast("date").alias("release_date"), F.array_repeat(feature, F.col("n")).alias("features"), F.array(F.lit("b")).alias("breaking_changes"))
    return packages.timeline(rows, "Brand#2").select("language", "version", "features", "breaking", F.array_join(F.array_distinct("high_impact"), ",").alias("high_impact"))


@query("""SELECT p_brand AS version, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')""")
def searched_features(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    feature = F.struct(F.col("p_name").alias("name"), F.lit("").alias("description"), F.array("p_type").alias("tags"), F.lit("Async").alias("category"))
    return packages.search_features(part.select(F.lit("x").alias("language"), F.col("p_brand").alias("version"), F.array(feature).alias("features")), "RING", "Async").select("version", "name")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'high:a,critical:b' ELSE 'critical:b' END AS kept FROM supplier""")
def severe_suggestions(spark, sf_dir):
    one = lambda severity, message: F.struct(severity.alias("severity"), F.lit(message).alias("message"), F.lit("e").alias("example"))
    given = F.array(one(F.when(F.col("s_suppkey") % 2 == 0, "high").otherwise("low"), "a"), one(F.lit("critical"), "b"))
    kept = packages.suggestions_at_least(given, ("low", "high", "critical"), "high", examples=False)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(kept, lambda s: F.concat(s["severity"], F.lit(":"), s["message"])), ",").alias("kept"))


@query("""SELECT round(avg(p_size / 50.0), 6) AS quality, sum(p_size)::BIGINT AS apis, 2 * count(*) AS tutorials FROM part""")
def library_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_size") / 50.0).alias("quality"), F.array_repeat(F.lit("a"), F.col("p_size")).alias("apis"), F.array(F.lit("t"), F.lit("u")).alias("tutorials"))
    return packages.library_statistics(rows).withColumn("quality", F.round("quality", 6))


@query("""SELECT page_id, 'T' || page_id AS title, 'main text of ' || page_id || repeat(' word', 30) AS main, 'rust' AS language, 'let value = ' || page_id AS code, 'https://h.org/a/' || page_id AS link, '/i.png' AS image, 1 AS apis FROM pages""")
def extracted_parts(spark, sf_dir):
    key = F.col("page_id").cast("string")
    page = F.concat(F.lit("<html><head><title>T"), key, F.lit("</title></head><body><nav>menu</nav><main>main text of "), key, F.lit(" word" * 30 + "</main><pre><code class='language-rust'>let value = "), key,
        F.lit("</code></pre><code>x</code><a href='/a/"), key, F.lit("'>go</a><a href='#x'>no</a><a href='mailto:a'>no</a><img src='/i.png' alt='i'><div class='method'><h3>Head</h3>" + "about the api " * 5 + "</div></body></html>"))
    rows = html.extract(table(spark, sf_dir, "pages").select("page_id", F.lit("https://h.org/p").alias("url"), page.alias("html")))
    e = F.col("extracted")
    return rows.select("page_id", e["title"].alias("title"), e["main"].alias("main"), F.get(e["code"], 0)["language"].alias("language"), F.get(e["code"], 0)["code"].alias("code"), F.get(e["links"], 0)["url"].alias("link"), F.get(e["images"], 0)["url"].alias("image"), F.size(e["apis"]).alias("apis"))


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (TIMESTAMP '2024-01-31 00:00:00' - ts > INTERVAL 5 DAY) AS expired FROM events GROUP BY event_type""")
def expired_entries(spark, sf_dir):
    return windows.cache_stats(table(spark, sf_dir, "events"), "2024-01-31 00:00:00", 5 * 86400, keys=["event_type"]).select("event_type", "total", "expired")
