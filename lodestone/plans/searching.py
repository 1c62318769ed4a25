"""Queries of search and the document store."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import search, store, text_index, vector_index
from lodestone.plans.base import list_sql, query, table
from lodestone.runtime import scratch_path

QUERY = "the tion version of license"


def _vector(spark, sf_dir, vec_id=0):
    return [float(x) for x in table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


_L2 = "list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_Q0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT e.vec_id, round(1 / (1 + {_L2}), 6) AS score FROM embeddings e, {_Q0} ORDER BY score DESC, vec_id LIMIT 10")
def knn_l2_topk(spark, sf_dir):
    return search.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir))


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, {_Q0} ORDER BY score DESC, vec_id LIMIT 10")
def knn_cosine_topk(spark, sf_dir):
    return search.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), metric="cosine")


@query(f"""
SELECT query_id, id, score, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(1 / (1 + {_L2}), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 / (1 + {_L2}), 6) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id) WHERE rank <= 5""")
def knn_batch_l2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.knn_batch(vectors, queries, 5, exclude_self=True)


def _every_twentieth(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(f"""
SELECT query_id, id, score, rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, round(1 / (1 + {_L2}), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 / (1 + {_L2}), 6) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0) WHERE rank <= 10""")
def vector_index_search(spark, sf_dir):
    """The index without a limit of probes: exact, by the cells' and the codes' bounds."""
    vectors, queries = _every_twentieth(spark, sf_dir)
    return vector_index.search(vector_index.build(vectors), queries, 10)


@query()
def vector_index_probes(spark, sf_dir):
    """As many probes as a measured recall of 0.9 asks for; approximate, so tested by its recall."""
    vectors, queries = _every_twentieth(spark, sf_dir)
    index = vector_index.build(vectors)
    probes, _ = vector_index.calibrate(index, vectors, queries.orderBy("query_id").limit(100), exclude_self=True)
    return vector_index.search(index, queries, 10, probes=probes, exclude_self=True)


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("").alias("title"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("package_name"), F.lit("").alias("doc_type")
    )


_TERMS = sorted({w for w in QUERY.split() if len(w) > 2})
_KEYWORD = " + ".join(f"least(CASE WHEN contains(lower(text), '{w}') THEN 0.4 ELSE 0 END + CASE WHEN contains(lower(text), ' {w} ') THEN 0.2 ELSE 0 END, 1.0)" for w in _TERMS)


@query(f"""
WITH near AS (SELECT e.vec_id, round(1 / (1 + {_L2}), 6) AS similarity FROM embeddings e, {_Q0} ORDER BY similarity DESC, vec_id LIMIT 20)
SELECT doc_id, round(0.6 * similarity + 0.3 * ({_KEYWORD}) / {len(_TERMS)}
  + CASE WHEN contains('{QUERY}', lower(lang)) THEN 0.1 ELSE 0 END + CASE WHEN contains('{QUERY}', lower(source)) THEN 0.1 ELSE 0 END, 6) AS score
FROM near JOIN documents ON vec_id = doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_search_topk(spark, sf_dir):
    return search.hybrid_search(_documents(spark, sf_dir), table(spark, sf_dir, "embeddings"), QUERY, _vector(spark, sf_dir)).select("doc_id", "score")


def _bm25_sql(terms, limit):
    f = ", ".join(rf"len(list_filter(ws, lambda w: w = '{t}')) AS f{i}" for i, t in enumerate(terms))
    d = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    s = " + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(terms)))
    return rf"""
SELECT doc_id, score FROM (
  SELECT doc_id, round({s}, 6) AS score FROM (
    SELECT doc_id, len(ws) AS n, {f} FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM documents)) c,
    (SELECT count(*) AS docs, avg(n) AS mean, {d} FROM (
      SELECT len(ws) AS n, {f} FROM (SELECT list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '') AS ws FROM documents))) k)
WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {limit}"""


_BM25 = _bm25_sql(sorted(set(QUERY.split())), 10)


@query(_BM25)
def bm25_topk(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), QUERY)


_QUERIES = (QUERY, "license", "the and of in die der le la", "nowhere tion zzz")


@query(" UNION ALL ".join(f"SELECT {k} AS query, doc_id, score FROM ({_bm25_sql(sorted(set(q.split())), 10)})" for k, q in enumerate(_QUERIES)))
def text_index_topk(spark, sf_dir):
    """BM25 by the impact-ordered index; what every query reads of it follows the best documents, not the corpus."""
    root = scratch_path(spark, "text-index")
    text_index.build(table(spark, sf_dir, "documents"), root)
    found = None
    for k, q in enumerate(_QUERIES):
        rows = text_index.search(spark, root, q).rows.select(F.lit(k).alias("query"), F.col("id").alias("doc_id"), "score")
        found = rows if found is None else found.unionByName(rows)
    return found


@query(f"""
WITH a AS ({_bm25_sql(sorted(set(QUERY.split())), 20)}),
b AS (SELECT e.vec_id AS doc_id, round(1 / (1 + {_L2}), 6) AS score FROM embeddings e, {_Q0} ORDER BY score DESC, e.vec_id LIMIT 20)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.score, 0) AS text_score, coalesce(b.score, 0) AS semantic_score,
  CASE WHEN a.doc_id IS NULL THEN 'Semantic' WHEN b.doc_id IS NULL THEN 'FullText' ELSE 'Hybrid' END AS match,
  round(0.7 * coalesce(a.score, 0) + 0.3 * coalesce(b.score, 0), 6) AS score
FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id ORDER BY score DESC, 1 LIMIT 10""")
def fused_search_full_outer(spark, sf_dir):
    near = search.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20).withColumnRenamed("vec_id", "doc_id")
    return search.fuse(search.bm25(table(spark, sf_dir, "documents"), QUERY, 20), near)


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def point_lookup(spark, sf_dir):
    return store.get(table(spark, sf_dir, "documents"), 42).select("doc_id", "lang", "source", "n_chars")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def paged_documents(spark, sf_dir):
    return store.page(table(spark, sf_dir, "documents"), 50, 25).select("doc_id", "source")


@query("""SELECT doc_id, lang, CASE WHEN contains(lower(source), 'license') OR contains(lower(text), 'license') THEN 0.8 ELSE 0.1 END AS score FROM documents
WHERE lang IN ('en', 'de') AND (contains(lower(source), 'license') OR contains(lower(text), 'license'))""")
def filtered_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("score", search.substring_score(F.col("source"), F.col("text"), "license"))
    return search.filtered(docs, languages=["en", "de"], threshold=0.5, language="lang").select("doc_id", "lang", "score")


_REL = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in QUERY.split())


@query(f"""SELECT doc_id, round(least(CASE WHEN lang = 'en' THEN 0.3 ELSE 0 END + 0.5 * ({_REL}) / {len(QUERY.split())}
  + CASE WHEN strlen(text) > 100 THEN 0.1 ELSE 0 END + CASE WHEN strlen(text) > 500 THEN 0.1 ELSE 0 END, 1.0), 6) AS relevance,
  list_aggregate(list_filter({list_sql(QUERY.split())}, lambda w: contains(lower(text), w)), 'string_agg', ' ') AS matched FROM documents""")
def relevance_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    matched = search.matched_keywords(F.col("text"), QUERY)
    return docs.select("doc_id", F.round(search.relevance(F.col("text"), QUERY, F.col("lang"), "en"), 6).alias("relevance"), F.when(F.size(matched) > 0, F.array_join(matched, " ")).alias("matched"))


@query(r"""
WITH s AS (SELECT doc_id, text, list_filter(list_transform(list_filter(string_split(text, '.'), lambda s: contains(lower(s), 'the')), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: strlen(s) > 20)[1] AS hit FROM documents)
SELECT doc_id, CASE WHEN length(coalesce(hit, text)) > 200 THEN left(coalesce(hit, text), 200) || '...' ELSE coalesce(hit, text) END AS preview FROM s""")
def content_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", search.preview(F.col("text"), "the").alias("preview"))


@query("""SELECT vec_id, CASE label % 3 WHEN 0 THEN 'find rust crate cargo' WHEN 1 THEN 'find python pip package' ELSE 'find' END AS expanded FROM embeddings""")
def query_expansion(spark, sf_dir):
    language = F.when(F.col("label") % 3 == 0, "rust").when(F.col("label") % 3 == 1, "python").otherwise("cobol")
    return table(spark, sf_dir, "embeddings").select("vec_id", search.expand_query(F.lit("find"), language).alias("expanded"))


@query("""
WITH new AS (SELECT doc_id + 500 AS doc_id, source, n_chars FROM documents UNION ALL SELECT doc_id + 500, source || 'x', n_chars + 1 FROM documents),
one AS (SELECT doc_id, source, n_chars FROM new QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_chars, source) = 1)
SELECT doc_id, source, n_chars FROM documents UNION ALL SELECT doc_id, source, n_chars FROM one WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def upsert_insert_absent(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    shifted = docs.withColumn("doc_id", F.col("doc_id") + 500)
    return store.insert_absent(docs, shifted.union(shifted.withColumn("source", F.concat("source", F.lit("x"))).withColumn("n_chars", F.col("n_chars") + 1)), ["n_chars", "source"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id <> 7")
def delete_by_id(spark, sf_dir):
    return store.delete(table(spark, sf_dir, "documents").select("doc_id", "lang"), 7)


@query("""SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT doc_id, 'new', n_chars + 1 FROM documents WHERE doc_id % 10 = 0""")
def replace_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    new = docs.where("doc_id % 10 = 0").select("doc_id", F.lit("new").alias("source"), (F.col("n_chars") + 1).alias("n_chars"))
    return store.replace(docs, new)


@query("SELECT min(doc_id) AS doc_id, text_md5 FROM (SELECT doc_id, md5(text) AS text_md5 FROM documents) GROUP BY text_md5")
def first_wins_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return store.first_wins(docs, ["text_md5"], ["doc_id"])


@query("""
SELECT n.doc_id, CASE WHEN n.doc_id % 7 = 0 THEN 'blank' WHEN d.doc_id IS NOT NULL THEN 'existing' ELSE 'added' END AS status
FROM (SELECT doc_id + 500 AS doc_id FROM documents) n LEFT JOIN documents d ON d.doc_id = n.doc_id""")
def insert_statuses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = docs.select((F.col("doc_id") + 500).alias("doc_id"), F.col("text")).withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit(" \n ")).otherwise(F.col("text")))
    return store.insert_status(docs, new).select("doc_id", "status")


@query("SELECT DISTINCT lang, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.lang = documents.lang AND e.source = documents.source AND e.n_chars > 5000)")
def unprocessed_versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return store.unprocessed(docs.select("lang", "source").distinct(), docs.where("n_chars > 5000").select("lang", "source").distinct(), ["lang", "source"])


@query("SELECT lang, source, count(*) AS documents, count(DISTINCT n_chars) AS versions FROM documents GROUP BY lang, source")
def store_statistics(spark, sf_dir):
    return store.stats(table(spark, sf_dir, "documents"), "lang", "source", "n_chars")


@query("""
WITH s AS (SELECT source, doc_id, 0 AS k FROM documents WHERE n_chars > 15000 UNION ALL SELECT source, doc_id, 1 FROM documents WHERE lang = 'de')
SELECT source, doc_id FROM s QUALIFY k = min(k) OVER (PARTITION BY source)""")
def fallback_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return store.fallback([docs.where("n_chars > 15000").select("source", "doc_id"), docs.where("lang = 'de'").select("source", "doc_id")], ["source"])
