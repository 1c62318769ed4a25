"""Queries of ingest, fallback search, statistics of texts, links and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import chunk, insight, text, url
from lodestone.functions.vectors import mock_embedding
from lodestone.operators import ingest, languages, search
from lodestone.operators.store import first_wins
from lodestone.plans.base import list_sql, query, table

AS_OF = "2024-01-31 00:00:00"


def _fragments(spark, sf_dir):
    path = F.concat(F.lit("src/"), "source", F.lit("/doc"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".rs"))
    content = F.when(F.col("doc_id") % 11 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("package_name"), F.concat(F.lit("1."), F.col("doc_id") % 3).alias("version"), path.alias("file_path"), content.alias("content"))


_PATH = "'src/' || source || '/doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.rs' END"
_ID = f"lang || '/' || source || '/1.' || doc_id % 3 || '/' || {_PATH}"


@query(f"""SELECT {_ID} AS id, CASE WHEN doc_id % 11 = 0 THEN 'blank' WHEN doc_id % 5 = 0 THEN 'duplicate' WHEN doc_id % 5 = 1 THEN 'replaced' ELSE 'added' END AS status FROM documents""")
def fragment_ingest(spark, sf_dir):
    new = _fragments(spark, sf_dir)
    old = ingest.records(new.where("doc_id % 5 < 2").withColumn("content", F.when(F.col("doc_id") % 5 == 0, F.col("content")).otherwise(F.lit("12345 old"))))
    return ingest.ingest(old, new)[1]


@query(f"""SELECT {_ID} AS id, 'doc' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'documentation' ELSE 'source' END AS doc_type, 'src/' || source AS hierarchy, 8 AS dimension, doc_id % 11 <> 0 AS has_text FROM documents WHERE NOT contains(lower(source), 'test') AND NOT contains(lower(source), 'spec') AND NOT contains(lower(source), 'example') AND NOT contains(lower(source), 'demo')""")
def fragment_records(spark, sf_dir):
    made = ingest.records(_fragments(spark, sf_dir).where(~F.lower("package_name").rlike("test|spec|example|demo")))
    has_text = F.coalesce(F.length(F.trim(F.regexp_replace("content", r"\s+", ""))) > 0, F.lit(False))
    return made.select("id", "title", "doc_type", F.col("metadata")["hierarchy_path"].alias("hierarchy"), F.size("embedding").alias("dimension"), has_text.alias("has_text"))


@query(f"""SELECT {_ID} AS doc_id, md5(CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) || ' ' ELSE text END) AS content_hash, strlen(CASE WHEN doc_id % 11 = 0 THEN ' ' || chr(10) || ' ' ELSE text END) AS content_length, 2 AS level FROM documents""")
def vector_metadata(spark, sf_dir):
    return ingest.vector_metadata(_fragments(spark, sf_dir)).select("doc_id", "content_hash", "content_length", F.size("hierarchy_path").alias("level"))


_DIGEST = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(source, ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: (a * 31 + b) % 18446744073709551616::HUGEINT)"


@query(f"""WITH d AS (SELECT DISTINCT source, {_DIGEST} AS h FROM documents), r AS (SELECT source, list_transform(range(4), lambda k: ((h + k) % 18446744073709551616::HUGEINT % 1000)::DOUBLE / 1000) AS v FROM d)
SELECT source, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[4] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM r""")
def mock_embeddings(spark, sf_dir):
    v = mock_embedding(4)(F.col("source"))
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", v.alias("v")).select("source", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 3), 6).alias("last"))


_L2 = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"""
SELECT 'known' AS package, vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) = 1 AS best_match, 'stored' AS branch FROM (SELECT vec_id, round(1 / (1 + {_L2}), 6) AS score FROM embeddings e, {_Q0} WHERE label = 1 ORDER BY score DESC, vec_id LIMIT 3)
UNION ALL SELECT 'unknown', vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) = 1, 'temporary' FROM (SELECT vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q0} WHERE label % 2 = 0 ORDER BY score DESC, vec_id LIMIT 3)""")
def search_with_fallback(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = [float(x) for x in vectors.where("vec_id = 0").first()["embedding"]]
    found = [ingest.search_or_fallback(vectors.where(stored), vectors.where("label % 2 = 0"), asked).withColumn("package", F.lit(name)) for name, stored in (("known", "label = 1"), ("unknown", "label = -1"))]
    return found[0].unionByName(found[1]).select("package", "vec_id", "score", "best_match", "branch")


@query(f"""SELECT label, coalesce(bool_or(score >= 0.1 AND label % 2 = 0), false) AS cached, round((max(score) + 0.5) / 2, 6) AS final_score
FROM (SELECT label, round(1 / (1 + {_L2}), 6) AS score FROM embeddings e, {_Q0}) GROUP BY label""")
def cached_packages(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    asked = [float(x) for x in vectors.where("vec_id = 0").first()["embedding"]]
    hits = search.knn(vectors, asked, 1_000_000).join(vectors.select("vec_id", "label"), "vec_id")
    hits = hits.withColumn("package_name", F.when(F.col("label") % 2 == 0, "Serde").otherwise("tokio")).withColumn("language", F.lit("Rust"))
    return hits.groupBy("label").agg(ingest.is_cached(hits, "rust", "serde", 0.1).alias("cached"), F.round(ingest.final_score(F.max("score"), F.lit(0.5)), 6).alias("final_score"))


@query(f"""SELECT doc_id, {_PATH} AS file_path FROM documents WHERE lang = 'en' AND doc_id % 3 = 1 AND source < 't' AND doc_id % 2 = 0 AND n_chars / 1000.0 >= 1 ORDER BY doc_id LIMIT 20""")
def hierarchy_filter(spark, sf_dir):
    rows = _fragments(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("score")), "doc_id")
    rows = rows.withColumn("hierarchy_path", F.array(F.lit("src"), F.col("package_name"))).withColumn("file_type", F.when(F.col("doc_id") % 2 == 0, "documentation").otherwise("source"))
    found = ingest.within_hierarchy(rows.where("package_name < 't'"), language="en", version="1.1", prefix="src/", level=2, file_type="documentation", threshold=1.0, limit=20, order=["doc_id"])
    return found.select("doc_id", "file_path")


@query(r"""
WITH j AS (SELECT doc_id, list_aggregate(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 'string_agg', ' ') AS t, text FROM documents)
SELECT doc_id, md5(CASE WHEN length(coalesce(t, '')) <= 1500 THEN coalesce(t, '') ELSE regexp_replace(left(t, 1500), '(?s)^(.*) [^ ]*$', '\1') || '...' END) AS embedded,
  md5(CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END) AS preview FROM j""")
def embedding_texts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(insight.embedding_text(t)).alias("embedded"), F.md5(insight.fragment_preview(t)).alias("preview"))


_C = lambda w, t="text": f"((length({t}) - length(replace({t}, '{w}', ''))) // {len(w)})"
_STATS = rf"""SELECT doc_id, text, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS words, len(regexp_split_to_array(text, '[.!?]')) AS sentences, len(string_split(text, chr(10))) AS paragraphs,
  coalesce(list_sum(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda w: strlen(w))), 0)::DOUBLE AS bytes, {_C('```')} // 2 AS code_blocks, {_C('http')} + {_C('[')} AS links, {_C('#')} AS headings,
  least({' + '.join(f'{_C(w)} * {k}' for w, k in insight.COMPLEX_WORDS.items())}, 100)::DOUBLE AS complexity FROM documents"""
_QUALITY = "least(greatest(5 * (" + " + ".join(f"least({'word_length' if k == 'word_length' else k}, {top}) / {top}.0 * {w}" for k, (top, w) in insight.QUALITY_WEIGHTS.items()) + "), 1), 5)"


@query(f"""
WITH s AS ({_STATS}), m AS (SELECT *, CASE WHEN words > 0 THEN bytes / words ELSE 0 END AS word_length, words / sentences AS sentence_length FROM s)
SELECT doc_id, words, sentences, paragraphs, round(word_length, 6) AS word_length, code_blocks, links, headings, complexity, round({_QUALITY}, 6) AS quality,
  CASE WHEN {_QUALITY} >= 4.5 THEN 'excellent' WHEN {_QUALITY} >= 3.5 THEN 'good' WHEN {_QUALITY} >= 2.5 THEN 'fair' WHEN {_QUALITY} >= 1.5 THEN 'poor' ELSE 'bad' END AS grade,
  (words < 100)::INT + (headings = 0)::INT + (code_blocks = 0 AND words > 200)::INT + (sentence_length > 25)::INT + ({_QUALITY} < 3)::INT AS advice,
  round(greatest(least(least(least(words, 1000) / 100.0 + code_blocks + headings, 10) * 0.2 + (6 + 7 + 8 + 9) / 4.0 * 0.6 + 0.5 * 10 * 0.2, 10), 0), 6) AS composite FROM m""")
def text_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", insight.statistics(F.col("text"), "\n").alias("s")).withColumn("q", insight.statistical_quality(F.col("s")))
    six = [F.lit(float(x)) for x in (6, 7, 8, 9)]
    return rows.select("doc_id", "s.words", "s.sentences", "s.paragraphs", F.round("s.word_length", 6).alias("word_length"), "s.code_blocks", "s.links", "s.headings", "s.complexity", F.round("q", 6).alias("quality"),
        insight.grade(F.col("q")).alias("grade"), F.size(insight.recommendations(F.col("s"), F.col("q"))).alias("advice"), F.round(insight.composite(F.col("s"), *six, F.lit(0.5)), 6).alias("composite"))


_LOWER = "lower(text)"
_RELEVANT = " + ".join(f"{_C(w, _LOWER)} * {k}" for w, k in insight.RELEVANCE_WORDS.items())


@query(rf"""SELECT doc_id, round(least(({_RELEVANT} + 0.4) / {sum(insight.RELEVANCE_WORDS.values())}, 1.0), 6) AS relevance,
  len(list_filter({list_sql(insight.TOPICS)}, lambda w: contains(lower(text), w))[1:5]) AS topics,
  CASE WHEN regexp_matches(lower(text), 'fn |struct |impl ') THEN 'Rust' WHEN regexp_matches(lower(text), 'function |const |let ') THEN 'JavaScript' WHEN regexp_matches(lower(text), 'def |class |import ') THEN 'Python' ELSE 'Text' END AS language,
  len(regexp_extract_all(text, '\S+')) AS words, len(regexp_extract_all(text, '[.!?]')) AS marks FROM documents""")
def keyword_relevance(spark, sf_dir):
    t = F.col("text")
    plain = insight.plain_statistics(t, "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(insight.keyword_relevance(t, "source code"), 6).alias("relevance"), F.size(insight.topics(t)).alias("topics"), insight.guessed_language(t).alias("language"), plain["words"].alias("words"), plain["sentences"].alias("marks"))


_HITS = {k: rf"len(regexp_extract_all(regexp_replace(lower(text), '[^\p{{L}}]+', '  ', 'g'), '(?:^| )(?:{'|'.join(w)})(?: |$)'))" for k, w in insight.STOP_WORDS.items()}


@query(f"""WITH h AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _HITS.items())} FROM documents)
SELECT doc_id, CASE WHEN greatest(en, fr, de, es) = 0 THEN NULL WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS language FROM h""")
def natural_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", insight.natural_language(F.col("text")).alias("language"))


_RANKS = ", ".join(f"('{name}', '{g}', {k})" for name, profile in languages.PROFILES.items() for g, k in profile.items())
_LETTERS = r"' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' '"


@query(rf"""WITH profile(language, g, place) AS (VALUES {_RANKS}), names AS (SELECT DISTINCT language FROM profile),
p AS (SELECT doc_id, {_LETTERS} AS p FROM documents WHERE regexp_matches(text, '\p{{L}}')),
c AS (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, length(p) - 1), lambda k: substring(p, k::INT, 3))) AS g FROM p) GROUP BY doc_id, g),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) - 1 AS k FROM c QUALIFY k < {languages.SIZE}),
a AS (SELECT r.doc_id, names.language, sum(CASE WHEN place IS NULL THEN {languages.SIZE} ELSE abs(k - place) END) AS away, count(*) AS grams FROM r CROSS JOIN names LEFT JOIN profile ON profile.language = names.language AND profile.g = r.g GROUP BY 1, 2)
SELECT d.doc_id, language, coalesce(round(1 - away / ({languages.SIZE} * grams), 6), 0.0) AS nearness FROM documents d
LEFT JOIN (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY away, language) = 1) a ON a.doc_id = d.doc_id""")
def language_detection(spark, sf_dir):
    """Script and trigram ranks over whole texts; all of these texts are in the Latin script."""
    return languages.detect(table(spark, sf_dir, "documents"))


_SHORT = "'see the rust api docs of ' || p_name || ' with tokio and async code ' || repeat('word ', p_size * 30) || ' quality: about ' || p_size % 12 || '/10'"


@query(rf"""SELECT p_partkey, 'documentation' AS type, 'rust' || CASE WHEN contains(p_name, 'go') THEN ' go' ELSE '' END AS languages, 'tokio async' AS technologies, 'async api' AS topics,
  CASE WHEN n <= 50 THEN 1 WHEN n <= 200 THEN 2 WHEN n <= 500 THEN 3 WHEN n <= 1000 THEN 4 ELSE 5 END AS difficulty, greatest(least((p_size % 12)::DOUBLE, 10), 1) AS score, 6.0::DOUBLE AS missing
FROM (SELECT *, 16 + len(string_split(p_name, ' ')) - 3 + p_size * 30 AS n FROM part)""".replace("16 + len(string_split(p_name, ' ')) - 3 + p_size * 30", rf"len(regexp_extract_all({_SHORT}, '\S+'))"))
def text_semantics(spark, sf_dir):
    t = F.concat(F.lit("see the rust api docs of "), "p_name", F.lit(" with tokio and async code "), F.expr("repeat('word ', p_size * 30)"), F.lit(" quality: about "), F.col("p_size") % 12, F.lit("/10"))
    # the texts are some hundred times the table, of which a task would read more rows than it can make texts of
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(4 * spark.sparkContext.defaultParallelism)
    rows = parts.select("p_partkey", t.alias("t"))
    rows = rows.select("p_partkey", insight.semantics(F.col("t")).alias("s"), insight.score_in_text(F.col("t"), "Quality").alias("score"), insight.score_in_text(F.col("t"), "clarity").alias("missing"))
    return rows.select("p_partkey", "s.type", *[F.array_join(f"s.{c}", " ").alias(c) for c in ("languages", "technologies", "topics")], "s.difficulty", "score", "missing")


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""")
def ascii_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(insight.ascii_only(F.col("text"))).alias("digest"))


_U = "lower(url)"
_TYPE = f"CASE WHEN contains({_U}, 'doc') THEN 'Documentation' WHEN contains({_U}, 'tutorial') OR page_id % 4 = 0 THEN 'Tutorial' WHEN contains({_U}, 'api') THEN 'ApiReference' WHEN contains({_U}, 'example') THEN 'Example' WHEN contains({_U}, 'download') THEN 'Download' WHEN contains({_U}, 'github.com') OR contains({_U}, 'gitlab.com') THEN 'ExternalReference' ELSE 'Related' END"


@query(f"""
WITH r AS (SELECT page_id, round(least(CASE WHEN contains({_U}, 'page') THEN 0.4 ELSE 0 END + CASE WHEN contains({_U}, 'en') THEN 0.3 ELSE 0 END + CASE WHEN page_id % 3 = 0 THEN 0.2 ELSE 0 END
  + CASE WHEN contains({_U}, 'github.com') OR contains({_U}, 'docs.rs') OR contains({_U}, 'python.org') OR contains({_U}, 'doc.rust-lang.org') THEN 0.2 ELSE 0 END
  + {' + '.join(f"CASE WHEN contains({_U}, '{w}') THEN 0.1 ELSE 0 END" for w in ('doc', 'tutorial', 'example', 'api'))}, 1.0), 6) AS relevance, {_TYPE} AS type FROM pages),
b AS (SELECT *, CASE type WHEN 'Documentation' THEN 5 WHEN 'ApiReference' THEN 5 WHEN 'Tutorial' THEN 4 WHEN 'Example' THEN 4 WHEN 'Download' THEN 3 WHEN 'ExternalReference' THEN 3 ELSE 2 END AS base FROM r)
SELECT page_id, relevance, type, CASE WHEN relevance > 0.7 THEN least(base + 1, 5) WHEN relevance < 0.3 THEN greatest(base - 1, 1) ELSE base END AS priority FROM b""")
def link_scores(spark, sf_dir):
    context = F.concat(F.when(F.col("page_id") % 3 == 0, "a Page ").otherwise(""), F.when(F.col("page_id") % 4 == 0, "Tutorial").otherwise(""))
    rows = table(spark, sf_dir, "pages").select("page_id", F.round(insight.link_relevance(F.col("url"), context, "page", "en"), 6).alias("r"), insight.link_type(F.col("url"), context).alias("type"))
    return rows.select("page_id", F.col("r").alias("relevance"), "type", insight.link_priority(F.col("type"), F.col("r")).alias("priority"))


@query("""SELECT page_id, 'b c d ' || url || ' e f g' AS context FROM pages""")
def link_contexts(spark, sf_dir):
    t = F.concat(F.lit("a b c d\n"), "url", F.lit("  e f g h"))
    return table(spark, sf_dir, "pages").select("page_id", insight.link_context(t, F.col("url")).alias("context"))


@query(f"""SELECT page_id, contains({_U}, 'en') OR {' OR '.join(f"contains({_U}, '{w}')" for w in ('changelog', 'changes', 'history', 'releases', 'tags', 'versions', 'docs', 'documentation', 'wiki'))} AS relevant FROM pages""")
def relevant_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", url.is_relevant(F.col("url"), "en").alias("relevant"))


@query(r"""WITH h AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS base FROM pages)
SELECT base, base || unnest(['/changelog', '/changes', '/releases', '/history', '/whatsnew', '/news', '/updates', '/versions']) AS url FROM h""")
def generated_doc_urls(spark, sf_dir):
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select(base.alias("base")).distinct().select("base", F.explode(url.documentation_urls(F.col("base"))).alias("url"))


@query(r"""SELECT p_partkey, unnest(['https://github.com/o/r' || p_partkey || '/releases', 'https://github.com/o/r' || p_partkey || '/tags', 'https://github.com/o/r' || p_partkey || '/blob/main/CHANGELOG.md',
  'https://github.com/o/r' || p_partkey || '/blob/master/CHANGELOG.md', 'https://github.com/o/r' || p_partkey || '/blob/main/CHANGES.md', 'https://github.com/o/r' || p_partkey || '/blob/master/CHANGES.md',
  'https://github.com/o/r' || p_partkey || '/blob/main/HISTORY.md', 'https://github.com/o/r' || p_partkey || '/blob/master/HISTORY.md', 'https://github.com/o/r' || p_partkey || '/wiki', 'https://o.github.io/r' || p_partkey,
  'https://api.github.com/repos/o/r' || p_partkey || '/releases']) AS url FROM part""")
def generated_repository_urls(spark, sf_dir):
    given = F.concat(F.lit("https://github.com/o/r"), "p_partkey", F.lit("/tree/main?x=1"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(url.repository_urls(given)).alias("url"))


@query("""SELECT p_partkey, round(least(CASE WHEN p_size % 2 > 0 THEN 0.3 ELSE 0 END + p_size / 50.0 * 0.4 + CASE WHEN p_size % 3 > 0 THEN 0.3 ELSE 0 END, 1.0), 6) AS relevance,
  round((CASE WHEN p_size % 2 > 0 THEN 0.8 ELSE 0.5 END + p_size / 50.0 + (0.4 + 0.6) / 2) / 3, 6) AS confidence, least(1000 * power(2, p_size - 1), 30000)::DOUBLE AS backoff,
  round(0.2 + CASE WHEN p_size % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.2 ELSE 0 END + 0.1, 6) AS quality,
  round(0.1 + CASE WHEN p_size % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 0.2 ELSE 0 END + 0.2, 6) AS completeness FROM part""")
def combined_scores(spark, sf_dir):
    size = F.col("p_size")
    scores = insight.library_scores(F.lit(True), size % 2 == 0, size % 3 == 0, size % 5 == 0, F.lit(True))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(insight.combined_relevance(size % 2, size / 50.0, F.when(size % 3 > 0, "q").otherwise("")), 6).alias("relevance"),
        F.round(insight.combined_confidence(size % 2, size / 50.0, F.lit(0.4), F.lit(0.6)), 6).alias("confidence"), insight.backoff_ms(size).alias("backoff"), scores["quality"].alias("quality"), scores["completeness"].alias("completeness"))


@query(r"""SELECT term, count(*) AS documents, sum(n)::BIGINT AS total FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term""")
def inverted_index(spark, sf_dir):
    return ingest.inverted_index(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("total"))


@query("""SELECT turn, conv_id, role, n FROM conversations JOIN (SELECT role, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY role) USING (role)
UNION ALL SELECT turn, conv_id, role, NULL FROM conversations WHERE role = 'system'""")
def scattered_results(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    counts = turns.where("role <> 'system'").groupBy("role").agg(F.count("*").alias("n"))
    return ingest.scatter(turns.select("conv_id", "turn", "role").withColumn("position", F.struct("conv_id", "turn")), counts, key="role").select("position.turn", "position.conv_id", "role", "n")


@query("""WITH t AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS n, n_nationkey FROM nation)
SELECT string_agg('## ' || n || '. ' || n_name || chr(10) || 'key ' || n_nationkey, chr(10) || chr(10) ORDER BY n) AS report FROM t""")
def formatted_results(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_name", F.concat(F.lit("key "), "n_nationkey").alias("content"))
    return ingest.formatted(rows, order=["n_name"], title="n_name")


@query("""
WITH c AS (SELECT user_id AS key, max(ts) AS cached_at, count(*) AS versions FROM events WHERE user_id % 5 <> 0 GROUP BY user_id),
s AS (SELECT user_id AS key, sum(event_id)::BIGINT AS versions FROM events WHERE user_id % 3 = 0 GROUP BY user_id), a AS (SELECT DISTINCT user_id AS key FROM events)
SELECT a.key, CASE WHEN TIMESTAMP '2024-01-31 00:00:00' - cached_at <= INTERVAL 3 DAY THEN c.versions WHEN s.key IS NOT NULL THEN s.versions ELSE c.versions END AS versions,
  CASE WHEN TIMESTAMP '2024-01-31 00:00:00' - cached_at <= INTERVAL 3 DAY THEN 'cache' WHEN s.key IS NOT NULL THEN 'source' WHEN c.key IS NOT NULL THEN 'stale' ELSE 'none' END AS origin
FROM a LEFT JOIN c ON c.key = a.key LEFT JOIN s ON s.key = a.key""")
def cached_versions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("user_id", "key")
    cache = events.where("key % 5 <> 0").groupBy("key").agg(F.max("ts").alias("cached_at"), F.count("*").alias("versions"))
    source = events.where("key % 3 = 0").groupBy("key").agg(F.sum("event_id").alias("versions"))
    return ingest.cached_versions(events.select("key").distinct(), cache, source, as_of=AS_OF, ttl_seconds=3 * 86400)


@query("""SELECT doc_id, md5(string_agg(substring(text, k * 900 + 1, 1000), '|' ORDER BY k)) AS digest, count(*) AS n FROM documents, unnest(range(greatest(ceil((length(text) - 1000) / 900.0), 0)::INT + 1)) AS t(k) WHERE length(text) > 1000 GROUP BY doc_id
UNION ALL SELECT doc_id, md5(text), 1 FROM documents WHERE length(text) BETWEEN 1 AND 1000""")
def searchable_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", chunk.fixed_chunks(F.col("text")).alias("c"))
    return rows.select("doc_id", F.md5(F.array_join("c", "|")).alias("digest"), F.size("c").cast("long").alias("n"))


@query("""SELECT count(*) AS documents, count(DISTINCT lang) AS languages, round(100.0 * count(*) / 20000, 6) AS percent_used, (count(*) > 0) AS has_any, count(*) FILTER (doc_id = 42) AS hits, count(*) FILTER (doc_id = -1) AS misses FROM documents""")
def status_report(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("languages"), F.round(100.0 * F.count("*") / 20_000, 6).alias("percent_used"), (F.count("*") > 0).alias("has_any"), F.count_if(F.col("doc_id") == 42).alias("hits"), F.count_if(F.col("doc_id") == -1).alias("misses"))


@query("""SELECT source, min_by(doc_id, (n_chars, doc_id)) AS oldest, count(*) - 1 AS left_over FROM documents GROUP BY source""".replace("min_by(doc_id, (n_chars, doc_id))", "arg_min(doc_id, struct_pack(n := n_chars, d := doc_id))"))
def evicted_oldest(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("oldest"), (F.count("*") - 1).alias("left_over"))


@query("""SELECT coalesce(nullif(CASE WHEN r_regionkey % 2 = 0 THEN r_name END, ''), 'general') AS language, count(*) AS tools, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def tools_per_language(spark, sf_dir):
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    language = F.coalesce(F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")), F.lit("general"))
    return joined.groupBy(language.alias("language")).agg(F.count("*").alias("tools"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))


@query("""SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def longest_candidate(spark, sf_dir):
    return first_wins(table(spark, sf_dir, "documents"), ["lang", "source"], [F.desc("n_chars"), "doc_id"]).select("lang", "source", "doc_id")


_LOW = "lower(text)"
_LISTED = lambda words: f"list_aggregate(list_filter({list_sql(words)}, lambda w: contains({_LOW}, w)), 'string_agg', ' ')"


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {' OR '.join(f"contains({_LOW}, '{m}')" for m in marks)} THEN '{name}'" for name, marks in insight.TEXT_TYPES) + f""" ELSE 'unknown' END AS type,
  coalesce({_LISTED(insight.LANGUAGES)}, '') AS languages, coalesce({_LISTED(insight.TECHNOLOGIES)}, '') AS technologies, coalesce({_LISTED(insight.SUBJECTS)}, '') AS topics,
  CASE WHEN n <= 50 THEN 1 WHEN n <= 200 THEN 2 WHEN n <= 500 THEN 3 WHEN n <= 1000 THEN 4 ELSE 5 END AS difficulty FROM (SELECT *, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)""")
def document_semantics(spark, sf_dir):
    s = insight.semantics(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", "s.type", *[F.array_join(f"s.{c}", " ").alias(c) for c in ("languages", "technologies", "topics")], "s.difficulty")
