"""Queries of page pipelines, library crawls, discovery and the store's further operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import apidoc, html, insight, url
from lodestone.operators import crawl, search, store
from lodestone.plans import code as code_plans
from lodestone.plans.base import query, table
from lodestone.plans.web import _LINKS, _plain
from lodestone.runtime import scratch_path
from lodestone.streaming import windows

_ARTICLE = r"regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
_BARE = rf"trim(regexp_replace(regexp_replace(regexp_replace({_ARTICLE}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
_HITS = {k: rf"len(regexp_extract_all(regexp_replace(lower(main), '[^\p{{L}}]+', '  ', 'g'), '(?:^| )(?:{'|'.join(w)})(?: |$)'))" for k, w in insight.STOP_WORDS.items()}


@query(rf"""SELECT page_id, md5({_BARE}) AS main, CASE WHEN strlen({_BARE}) >= 120 THEN 'main' ELSE 'fallback' END AS chosen FROM pages""")
def regex_main_content(spark, sf_dir):
    main = html.regex_main(F.col("html"))
    chosen = html.longest(F.lit("x" * 119), main)  # of equals the first, the fallback
    return table(spark, sf_dir, "pages").select("page_id", F.md5(main).alias("main"), F.when(chosen == main, "main").otherwise("fallback").alias("chosen"))


@query(rf"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ''), 'Documentation') AS title, 'Package documentation' AS description, strlen(html) AS length FROM pages""")
def page_heads(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.head(F.col("html")).alias("h")).select("page_id", "h.*")


@query(rf"""{_LINKS}, g AS (SELECT page_id, count(*) AS links FROM u GROUP BY page_id),
m AS (SELECT page_id, {_plain("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS title, {_plain("regexp_extract(h, '(?s)<article[^>]*>(.*?)</article>', 1)")} AS a, {_plain("regexp_extract(h, '(?s)<body[^>]*>(.*?)(?:</body>|$)', 1)")} AS b FROM p),
c AS (SELECT page_id, title, CASE WHEN strlen(a) >= 100 THEN a ELSE b END AS main FROM m), h AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _HITS.items())} FROM c)
SELECT h.page_id, title, strlen(main) AS bytes, coalesce(links, 0) AS links, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS language,
  round((strlen(title) > 0)::INT * 0.2 + (strlen(main) > 200)::INT * 0.3 + (coalesce(links, 0) > 0)::INT * 0.2 + 0.15 * (greatest(en, fr, de, es) > 0)::INT, 6) AS completeness FROM h LEFT JOIN g ON g.page_id = h.page_id""")
def page_pipeline(spark, sf_dir):
    from lodestone.functions import quality

    rows = html.extract(table(spark, sf_dir, "pages")).select("page_id", "extracted.title", "extracted.main", "extracted.links")
    rows = rows.withColumn("language", insight.natural_language(F.col("main")))
    complete = quality.completeness(F.col("title"), F.col("main"), F.col("links"), F.lit(None).cast("string"), F.col("language"))
    return rows.select("page_id", "title", F.octet_length("main").alias("bytes"), F.size("links").cast("long").alias("links"), "language", F.round(complete, 6).alias("completeness"))


@query("""SELECT count(*) AS files, (SELECT count(*) FROM documents WHERE NOT (lang = 'en' AND source = (SELECT min(source) FROM documents))) AS left_over, count(*) > 0 AS there FROM (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en' AND source = (SELECT min(source) FROM documents))""")
def store_contract(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("file_path", F.concat(F.lit("f"), "doc_id"))
    keys = {"lang": "en", "source": docs.agg(F.min("source")).first()[0]}
    there = store.exists(docs, (F.col("lang") == "en") & (F.col("source") == keys["source"]))
    left = store.delete_package(docs, keys).agg(F.count("*").alias("left_over"))
    return store.files(docs, keys).agg(F.count("*").alias("files")).crossJoin(F.broadcast(left)).withColumn("there", F.lit(there))  # one row each


@query(r"""WITH t AS (SELECT DISTINCT vec_id, w FROM (SELECT vec_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM documents JOIN embeddings ON vec_id = doc_id))
SELECT (SELECT count(*) FROM t) AS postings, (SELECT count(DISTINCT w) FROM t) AS terms, (SELECT count(*) FROM embeddings JOIN documents ON vec_id = doc_id) AS vectors""")
def dual_write(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    terms, vectors = store.write_both(docs.select("doc_id", "text", "embedding"), scratch_path(spark, "both"))
    counts = spark.read.parquet(terms).agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))
    return counts.crossJoin(F.broadcast(spark.read.parquet(vectors).agg(F.count("*").alias("vectors"))))  # one row each


@query("""SELECT vec_id, round(0.6 * label / 10 + 0.4 * coalesce(n_chars / 30000.0, 0), 6) AS score FROM embeddings LEFT JOIN documents ON doc_id = vec_id""")
def weighted_hybrid(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents"), F.col("doc_id") == F.col("vec_id"), "left")
    return rows.select("vec_id", F.round(search.weighted(F.col("label") / 10, F.col("n_chars") / 30000.0, 0.6, 0.4), 6).alias("score"))


@query("""SELECT page, depth FROM (SELECT page_id // 2 AS page, (page_id % 4)::INT AS depth, page_id % 10 / 10.0 AS score, row_number() OVER (PARTITION BY page_id // 2 ORDER BY page_id % 4, page_id % 10 DESC) AS r
  FROM pages WHERE page_id % 4 < 3 AND page_id % 10 / 10.0 >= 0.3) WHERE r = 1 AND page % 5 <> 0""")
def accepted_tasks(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    key = F.col("page_id")
    asked = pages.select(F.floor(key / 2).alias("page"), (key % 4).cast("int").alias("depth"), (key % 10 / 10.0).alias("score"))
    visited = pages.where("page_id % 5 = 0").select(F.col("page_id").alias("page"))
    return crawl.accepted(asked, visited, max_depth=3, min_score=0.3).select("page", "depth")


@query(r"""WITH k AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS library, CASE page_id % 4 WHEN 0 THEN 'api' WHEN 1 THEN 'tutorial' WHEN 2 THEN 'example' ELSE 'other' END AS kind FROM pages),
c AS (SELECT library, count(*) FILTER (kind = 'api') AS api, count(*) FILTER (kind = 'tutorial') AS tutorial, count(*) FILTER (kind = 'example') AS example, count(*) FILTER (kind = 'other') AS other FROM k GROUP BY library)
SELECT *, round((other > 0)::INT * 0.2 + (api > 0)::INT * 0.3 + (tutorial > 0)::INT * 0.2 + (example > 0)::INT * 0.2, 6) AS quality, round((other > 0)::INT * 0.1 + (api > 0)::INT * 0.3 + (tutorial > 0)::INT * 0.2 + (example > 0)::INT * 0.2, 6) AS completeness FROM c""")
def library_crawl(spark, sf_dir):
    route = F.element_at(F.array(*map(F.lit, ("api", "tutorial", "example", "other"))), (F.col("page_id") % 4 + 1).cast("int"))
    return crawl.library(table(spark, sf_dir, "pages").withColumn("library", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)), route)


@query(r"""SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS library, 'doc,api,reference' AS keywords, 3 AS max_depth, 50 AS max_pages FROM pages""")
def crawl_tasks(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("library"), F.lit("u").alias("url")).distinct()
    return crawl.tasks(hosts, "documentation").select("library", F.array_join("keywords", ",").alias("keywords"), "max_depth", "max_pages")


@query(r"""WITH b AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS base FROM pages),
f AS (SELECT unnest(['/docs', '/documentation', '/api', '/reference', '/guide', '/tutorial', '/examples', '/readme', '/manual', '/help', '/wiki', '/getting-started', '/godoc', '/docs/go', '/latest', '/latest/godoc', '/latest/docs/go', '/stable', '/stable/godoc', '/stable/docs/go']) AS f)
SELECT base, base || f AS url FROM b, f""")
def discovered_urls(spark, sf_dir):
    base = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1).alias("base")).distinct()
    return base.select("base", F.explode(url.discovered(F.col("base"), "go")).alias("url"))


@query("""SELECT sha256(concat_ws(chr(31), user_id::VARCHAR, event_type)) AS key, max(ts) AS ts, TIMESTAMP '2024-01-31 00:00:00' - max(ts) <= INTERVAL 3 DAY AS valid FROM events GROUP BY user_id, event_type""")
def response_cache(spark, sf_dir):
    return windows.response_cache(table(spark, sf_dir, "events"), ["user_id", "event_type"], "2024-01-31 00:00:00", 3 * 86400)


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 1 END::BIGINT AS line FROM part""")
def mined_examples(spark, sf_dir):
    files = code_plans._files(spark, sf_dir)
    name = F.concat(F.element_at(F.array(*map(F.lit, ("get_", "is_", "sell_", "update_"))), (F.col("p_partkey") % 4 + 1).cast("int")), "p_partkey", F.lit("("))
    return files.select("p_partkey", apidoc.mined_example(F.col("code"), name)["line"].cast("long").alias("line"))
