"""Queries over pages and URLs, and over the text of documents as web content."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import classify, density, html, url, version_keys, versions
from lodestone.operators.store import first_wins
from lodestone.plans.base import query, table, words_sql

_STRIP = lambda gap: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '{gap}', 'g'), '(?s)<style[^>]*>.*?</style>', '{gap}', 'g'), '(?s)<!--.*?-->', '{gap}', 'g'), '<[^>]*>', '{gap}', 'g')"
_DECODED = _STRIP("")
for _entity, _sign in html.ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_sign.replace(chr(39), chr(39) * 2)}')"


@query(rf"SELECT page_id, md5(trim(regexp_replace({_DECODED}, '\s+', ' ', 'g'), ' ')) AS digest FROM pages")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.clean(F.col("html"), "")).alias("digest"))


@query(rf"SELECT page_id, md5(trim(regexp_replace({_STRIP(' ')}, '\s+', ' ', 'g'), ' ')) AS digest FROM pages")
def squash_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.squash_tags(F.col("html"))).alias("digest"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), ' ') AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


_STRIPPED = r"regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
_LINKS = rf"""
WITH p AS (SELECT page_id, url, html, {_STRIPPED} AS h FROM pages),
l AS (SELECT page_id, url AS base, unnest(regexp_extract_all(h, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(h, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS body,
  generate_subscripts(regexp_extract_all(h, '(?s)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) AS k FROM p),
t AS (SELECT page_id, base, k, replace(href, '&amp;', '&') AS href, trim(regexp_replace(replace(regexp_replace(body, '<[^>]*>', '', 'g'), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS text FROM l),
u AS (SELECT page_id, k, text, CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN prefix(href, '/') THEN regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || href ELSE regexp_extract(base, '^([a-z]+://[^?#]*/)', 1) || href END AS url
FROM t WHERE strlen(text) BETWEEN 1 AND 199 AND href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:)'))"""


@query(f"{_LINKS} SELECT page_id, text, url FROM u")
def page_links(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", F.explode("extracted.links").alias("l")).select("page_id", "l.text", "l.url")


def _plain(x: str) -> str:
    """Text of a piece of HTML in SQL: tags to spaces, entities decoded, white space collapsed."""
    out = rf"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{sign}')"
    return rf"trim(regexp_replace({out}, '[\s\x{{00A0}}]+', ' ', 'g'), ' ')"


@query(rf"""{_LINKS}, g AS (SELECT page_id, string_agg('- [' || text || '](' || url || ')', chr(10) ORDER BY k) AS links FROM u GROUP BY page_id),
m AS (SELECT page_id, url, {_plain("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS title, {_plain("regexp_extract(h, '(?s)<article[^>]*>(.*?)</article>', 1)")} AS main, {_plain("regexp_extract(h, '(?s)<body[^>]*>(.*?)(?:</body>|$)', 1)")} AS body FROM p)
SELECT m.page_id, '# ' || title || chr(10) || chr(10) || url || chr(10) || chr(10) || CASE WHEN strlen(main) >= 100 THEN main ELSE body END || coalesce(chr(10) || chr(10) || '## Links' || chr(10) || chr(10) || links, '') AS markdown FROM m LEFT JOIN g ON g.page_id = m.page_id""")
def page_markdown(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", html.markdown(F.col("extracted"), F.col("url")).alias("markdown"))


@query(rf"""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) AS ls FROM documents)
SELECT doc_id, md5(coalesce(list_aggregate(list_filter(ls, lambda x: strlen(x) >= 10 AND len({words_sql('x')}) >= 3 AND NOT contains(lower(x), 'copyright') AND NOT contains(x, '©')
  AND NOT contains(lower(x), 'all rights reserved')), 'string_agg', chr(10)), '')) AS digest FROM l""")
def noise_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(html.drop_noise(F.col("text"))).alias("digest"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
_ANY = lambda t, ws: "(" + " OR ".join(f"contains({t}, '{w}')" for w in ws) + ")"
_TLD = " ".join(f"WHEN suffix(h, '{e}') THEN {s}" for e, s in url.TLD_SCORES)
_AUTH = f"""least(CASE WHEN {_ANY('h', url.HIGH_AUTHORITY)} THEN 0.9 WHEN {_ANY('h', url.MEDIUM_AUTHORITY)} THEN 0.7 ELSE CASE {_TLD} ELSE 0.3 END
  + CASE WHEN prefix(h, 'docs.') OR contains(h, 'documentation') THEN 0.2 ELSE 0 END + CASE WHEN contains(h, 'api') THEN 0.15 ELSE 0 END + CASE WHEN contains(h, 'wiki') THEN 0.1 ELSE 0 END END, 1.0)"""
_PTYPE = "CASE " + " ".join(f"WHEN {_ANY('lower(p)', ws)} THEN '{n}'" for n, ws, _ in url.PATH_TYPES) + " ELSE 'Other' END"
_PSCORE = "CASE " + " ".join(f"WHEN {_ANY('lower(p)', ws)} THEN {s}" for _, ws, s in url.PATH_TYPES) + " ELSE 0 END"
_SUB = "CASE WHEN prefix(h, 'docs.') OR contains(h, 'documentation') THEN 'Docs' WHEN contains(h, 'api') THEN 'Api' WHEN contains(h, 'wiki') THEN 'Wiki' WHEN contains(h, 'blog') THEN 'Blog' WHEN contains(h, 'download') THEN 'Download' ELSE 'Other' END"
_VER = r"regexp_matches(p, 'v?\d+\.\d+(\.\d+)?|version[/-]?\d+|release[/-]?\d+')"
_WORDS = f"len(regexp_extract_all(p, '{'|'.join(url.DOC_PATHS)}'))"
_U = f"(SELECT page_id, url, {_HOST} AS h, {_PATH} AS p FROM pages) u"


@query(rf"""SELECT page_id, h AS host, p AS path, len(list_filter(string_split(p, '/'), lambda s: s <> '')) AS depth,
  CASE WHEN contains(list_last(string_split(p, '/')), '.') THEN list_last(string_split(p, '.')) END AS extension, {_VER} AS has_version, {_WORDS} AS doc_words,
  {_SUB} AS subdomain, {_PTYPE} AS path_type FROM {_U}""")
def url_features(spark, sf_dir):
    h, p = url.host(F.col("url")), url.path(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", h.alias("host"), p.alias("path"), url.depth(p).alias("depth"), url.extension(p).alias("extension"), url.has_version(p).alias("has_version"),
        url.doc_words(p).alias("doc_words"), url.subdomain_type(h).alias("subdomain"), url.path_type(p).alias("path_type"),
    )


@query(f"""SELECT page_id, round({_AUTH}, 6) AS authority, {_ANY('h', url.OFFICIAL)} AS official,
  round(least(CASE WHEN {_ANY('h', url.DOC_SITES)} THEN 0.3 ELSE 0 END + 0.2 * {_AUTH} + CASE WHEN {_ANY('h', url.OFFICIAL)} THEN 0.2 ELSE 0 END + least(0.05 * {_WORDS}, 0.2)
  + CASE WHEN {_VER} THEN 0.1 ELSE 0 END + {_PSCORE} + 0.2 * CASE WHEN contains(lower(url), 'python') THEN 0.8 WHEN contains(lower(url), 'py') OR contains(lower(url), 'pypi') THEN 0.6 ELSE 0.2 END, 1.0), 6) AS relevance FROM {_U}""")
def url_authority(spark, sf_dir):
    h = url.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.round(url.authority(h), 6).alias("authority"), url.is_official(h).alias("official"), F.round(url.relevance(F.col("url"), "python"), 6).alias("relevance"))


_L = "lower(url)"
_CHG, _TAG, _DOC = _ANY(_L, ("changelog", "changes")), _ANY(_L, ("releases", "tags", "versions")), _ANY(_L, ("docs", "documentation", "wiki"))
_GIT, _REL = f"contains({_L}, 'github.com')", f"(contains({_L}, 'github.com') AND contains({_L}, '/releases'))"


@query(f"""
SELECT page_id, url, CASE WHEN {_CHG} THEN 'Changelog' WHEN {_REL} THEN 'GitHubRelease' WHEN {_TAG} THEN 'ReleaseNotes' WHEN {_DOC} THEN 'Documentation' ELSE 'Unknown' END AS url_type,
  round(least(0.1 + CASE WHEN contains({_L}, 'en') THEN 0.3 ELSE 0 END + CASE WHEN {_GIT} THEN 0.2 ELSE 0 END + CASE WHEN {_REL} THEN 0.3 ELSE 0 END + CASE WHEN {_CHG} THEN 0.4 ELSE 0 END
  + CASE WHEN {_TAG} THEN 0.3 ELSE 0 END + CASE WHEN {_DOC} THEN 0.2 ELSE 0 END, 1.0), 6) AS confidence, CASE WHEN {_REL} THEN 1 WHEN {_CHG} OR {_TAG} THEN 2 WHEN {_DOC} THEN 3 ELSE 5 END AS priority
FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1""")
def url_dedupe_sorted(spark, sf_dir):
    rows = first_wins(table(spark, sf_dir, "pages"), ["url"], ["page_id"]).withColumn("d", url.discovery(F.col("url"), "en"))
    out = rows.select("page_id", "url", "d.url_type", F.round("d.confidence", 6).alias("confidence"), "d.priority")
    kind = F.when(F.col("url_type") == "Changelog", 0).when(F.col("url_type") == "ReleaseNotes", 1).otherwise(2)
    return out.orderBy("priority", F.desc("confidence"), kind, "url")


@query(r"SELECT page_id, " + "coalesce(" + ", ".join("nullif(regexp_extract('https://x.org/' || 'v' || (page_id % 7) || '.' || page_id || '/d', '" + (m[0] + "(" + m[1:] + r"[0-9.]*)").replace(m[1:], m[1:].replace(".", r"\.")) + "', 1), '')" for m in url.VERSION_MARKS) + ") AS version FROM pages")
def url_version(spark, sf_dir):
    made = F.concat(F.lit("https://x.org/v"), (F.col("page_id") % 7).cast("string"), F.lit("."), F.col("page_id").cast("string"), F.lit("/d"))
    return table(spark, sf_dir, "pages").select("page_id", url.version(made).alias("version"))


_FOUND = lambda t, ws: "(" + " + ".join(f"CASE WHEN contains({t}, '{w}') THEN 1 ELSE 0 END" for w in ws) + ")"
_RX = lambda ps: "|".join(ps).replace("'", "''")


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{_RX(classify.CHANGELOG)}') THEN 'Changelog' WHEN {_FOUND('lower(text)', classify.RELEASE)} >= 2 THEN 'Release'
  WHEN regexp_matches(lower(text), '{_RX(classify.DOCS)}') THEN 'Documentation' WHEN regexp_matches(lower(text), '{_RX(classify.BLOG)}') THEN 'Blog' ELSE 'Other' END AS page_type,
  CASE WHEN n < 50 THEN 1 WHEN n < 200 THEN 2 WHEN n < 500 THEN 3 WHEN n < 1000 THEN 4 ELSE 5 END AS difficulty FROM (SELECT *, len({words_sql('text')}) AS n FROM documents)""")
def page_classification(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.page_type(F.col("text")).alias("page_type"), classify.difficulty(F.col("text")).alias("difficulty"))


@query(rf"""
WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, pos, CASE WHEN {_FOUND('t', classify.CODE_MARKS)} > 0 OR len(regexp_extract_all(t, '[{{}}()\[\];]')) / greatest(length(t), 1) > 0.05 THEN 'code'
  WHEN {_FOUND('lower(t)', classify.API_MARKS)} >= 2 THEN 'api' WHEN {_FOUND('lower(t)', classify.TUTORIAL_MARKS)} > 0 THEN 'tutorial'
  WHEN {_FOUND('lower(t)', classify.NAVIGATION_MARKS)} > 0 AND length(t) < 100 THEN 'navigation' ELSE 'text' END AS region FROM r""")
def region_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    return rows.select("doc_id", "pos", classify.region_type(F.col("t")).alias("region"))


@query(f"""SELECT doc_id, round(least(CASE WHEN strlen(text) > 500 AND strlen(text) < 50000 THEN 0.3 WHEN strlen(text) >= 200 THEN 0.1 ELSE 0 END + CASE WHEN contains(text, '# ') THEN 0.2 ELSE 0 END
  + CASE WHEN contains(text, '```') OR contains(text, '<code>') THEN 0.2 ELSE 0 END + least(0.05 * {_FOUND('lower(text)', classify.DOC_WORDS)}, 0.3), 1.0), 6) AS quality FROM documents""")
def content_quality(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(classify.content_quality(F.col("text")), 6).alias("quality"))


_COUNT = lambda w: f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}"


@query("SELECT doc_id, CASE WHEN greatest(j, p, r) = 0 THEN NULL WHEN j >= p AND j >= r THEN 'javascript' WHEN p >= r THEN 'python' ELSE 'rust' END AS language FROM (SELECT doc_id, "
       + ", ".join(f"{' + '.join(_COUNT(w) for w in ws)} AS {n[0]}" for n, ws in classify.LANGUAGE_WORDS.items()) + " FROM documents)")
def code_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", classify.code_language(F.col("text")).alias("language"))


@query(r"""SELECT doc_id, len(list_distinct(list_concat(list_concat(regexp_extract_all(text, '(?i)version\s+(\d+\.\d+(?:\.\d+)?)', 1), regexp_extract_all(text, '(?i)v?(\d+\.\d+(?:\.\d+)?)', 1)), regexp_extract_all(text, '(?i)release\s+(\d+\.\d+(?:\.\d+)?)', 1)))) AS versions,
  len(list_filter(list_transform(regexp_extract_all(text, '(?i)syntax\s+(.+)', 1), lambda x: trim(x, ' ')), lambda x: strlen(x) > 5)) AS syntax FROM documents""")
def changelog_versions(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(versions.mined_versions(t)).alias("versions"), F.size(versions.mined(t, versions.SYNTAX_PATTERNS[:1])).alias("syntax"))


_V = "(p_size || '.' || (p_partkey % 13) || '.' || (p_partkey % 7))"


@query(f"""SELECT p_partkey, {_V} AS version, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey % 13, p_partkey % 7, p_partkey) AS rank,
  (20 > p_size OR (20 = p_size AND (5 > p_partkey % 13 OR (5 = p_partkey % 13 AND 3 > p_partkey % 7)))) AS outdated FROM part""")
def version_sort(spark, sf_dir):
    from pyspark.sql import Window

    version = F.concat_ws(".", "p_size", F.col("p_partkey") % 13, F.col("p_partkey") % 7)
    rows = table(spark, sf_dir, "part").withColumn("version", version)
    return rows.select("p_partkey", "version", F.row_number().over(Window.partitionBy("p_brand").orderBy(version_keys.semver(F.col("version")), "p_partkey")).alias("rank"), versions.needs_update(F.col("version"), F.lit("20.5.3")).alias("outdated"))




_PLAIN = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""
WITH p AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '{density.NO_CONTENT}', ' ', 'g'), '{density.BLOCK_TAGS}') AS parts FROM pages WHERE html IS NOT NULL),
b AS (SELECT page_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS part FROM p),
w AS (SELECT page_id, pos, {_PLAIN('part')} AS text, coalesce(list_sum(list_transform(regexp_extract_all(part, '(?is)<a[^>]*>(.*?)</a\s*>', 1), lambda a: length({_PLAIN('a')}))), 0) AS linked FROM b),
s AS (SELECT page_id, pos, text, sum(length(text) - {density.LINK} * linked - {density.COST}) OVER (PARTITION BY page_id ORDER BY pos) AS up FROM w),
f AS (SELECT s.page_id, s.pos AS last, s.up - least(coalesce(min(t.up), 0), 0) AS total,
  coalesce(max(t.pos) FILTER (t.up = m.low), -1) + 1 AS first FROM s
  LEFT JOIN (SELECT page_id, pos, least(0, coalesce(min(up) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM s) m ON m.page_id = s.page_id AND m.pos = s.pos
  LEFT JOIN s t ON t.page_id = s.page_id AND t.pos < s.pos GROUP BY s.page_id, s.pos, s.up),
r AS (SELECT * FROM f WHERE total > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY total DESC, last) = 1)
SELECT r.page_id, first::INT AS first, last::INT AS last, total::BIGINT AS sum, md5(string_agg(text, chr(10) ORDER BY pos) FILTER (text <> '')) AS text_md5
FROM r JOIN s ON s.page_id = r.page_id AND pos BETWEEN first AND last GROUP BY r.page_id, first, last, total""")
def dense_main_content(spark, sf_dir):
    # a filter on m would work it out twice
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_compact(F.array(density.main_content(F.col("html"))))).alias("m"))
    return found.select("page_id", "m.first", "m.last", "m.sum", F.md5("m.text").alias("text_md5"))


@query("SELECT page_id, coalesce(" + ", ".join(f"nullif(regexp_extract(url, '{m[0]}(" + m[1:].replace(".", r"\.") + "[0-9.]*)', 1), '')" for m in url.VERSION_MARKS) + ") AS version FROM pages")
def page_url_versions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.version(F.col("url")).alias("version"))


@query(r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]+)"[^>]*>.*?</a>', 1)) AS target, trim(regexp_replace(unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]+"[^>]*>(.*?)</a>', 1)), '<[^>]*>', '', 'g')) AS shown FROM pages),
n AS (SELECT page_id, count(*) AS links FROM a WHERE NOT regexp_matches(target, '^(#|javascript:|mailto:)') AND strlen(shown) BETWEEN 1 AND 199 GROUP BY page_id)
SELECT page_id, replace(replace(replace(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title, coalesce(links, 0) AS links FROM pages LEFT JOIN n USING (page_id)""")
def page_parts(spark, sf_dir):
    rows = html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", F.col("extracted.title").alias("title"), F.size("extracted.links").cast("long").alias("links"))


@query("SELECT doc_id, " + ", ".join("(" + " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) // {len(w)}" for w in words) + f")::BIGINT AS {name}" for name, words in classify.API_STRUCTURES.items()) + " FROM documents")
def api_structure_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[classify.api_structures(F.col("text"), name).cast("long").alias(name) for name in classify.API_STRUCTURES])
