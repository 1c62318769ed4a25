"""Queries over documents: text functions, similarity, chunks, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import chunk, quality, table_functions, text
from lodestone.operators import profile, similarity
from lodestone.plans.base import ORACLES, list_sql, query, table, words_sql
from lodestone.runtime import materialize

_NORM = r"""trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}\s.,!?;:()\[\]{}"'']', '', 'g'), '\s+', ' ', 'g'))"""
_STOP = list_sql(text.STOP_WORDS)
_CONTENT = lambda t: f"list_filter(list_transform({words_sql(t)}, lambda w: lower(w)), lambda w: strlen(w) >= 2 AND NOT list_contains({_STOP}, w))"


@query(f"SELECT doc_id, md5({_NORM}) AS digest, length({_NORM}) AS n FROM documents")
def normalize_text(spark, sf_dir):
    own = text.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(own).alias("digest"), F.length(own).alias("n"))


@query(f"""
WITH t AS (SELECT doc_id, string_split(lower({_NORM}), ' ') AS ws FROM documents), w AS (SELECT doc_id, len(ws) AS total, unnest(ws) AS word FROM t)
SELECT doc_id, word, count(*) AS n, round(count(*) / any_value(total), 6) AS tf FROM w WHERE strlen(word) >= 2 AND word NOT IN (SELECT unnest({_STOP})) GROUP BY doc_id, word""")
def term_frequency(spark, sf_dir):
    return similarity.term_frequency(table(spark, sf_dir, "documents"))


@query(f"""
WITH w AS (SELECT doc_id, {words_sql(_NORM)} AS ws FROM documents)
SELECT doc_id, CASE WHEN len(ws) < 2 THEN 0 ELSE len(list_distinct(list_filter(list_transform(list_zip(ws[1:len(ws) - 1], ws[2:]), lambda p: p[1] || ' ' || p[2]), lambda g: strlen(g) >= 4))) END AS bigrams,
  len(list_distinct(ws)) AS vocabulary FROM w""")
def ngrams_bigram(spark, sf_dir):
    words = text.tokens(text.normalize(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.ngrams(words, 2)).alias("bigrams"), F.size(F.array_distinct(words)).alias("vocabulary"))


@query(rf"""
SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> '')) AS paragraphs,
  ((length(text) - length(replace(text, '```', ''))) // 6) AS code_blocks,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(- |\* |[0-9])'))) AS list_lines FROM documents""")
def structure_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.structure(F.col("text"), "\n").alias("s")).select("doc_id", "s.*")


_WORD = lambda g: rf"(?:^|[^\p{{L}}\p{{N}}_])({'|'.join(g.split())})"
_TERMS = f"list_filter({list_sql(text.TECHNICAL_TERMS)}, lambda t: contains(lower(text), t))"
_CAPS = rf"list_transform(list_filter({words_sql('text')}, lambda w: strlen(w) > 2 AND regexp_matches(w, '^\p{{Lu}}')), lambda w: lower(w))"


@query(f"SELECT doc_id, len(list_distinct(list_concat({_TERMS}, {_CAPS}))) AS terms, len({_TERMS}) AS listed FROM documents")
def technical_terms(spark, sf_dir):
    listed = F.filter(text.literal_array(text.TECHNICAL_TERMS), lambda t: F.contains(F.lower("text"), t))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.technical_terms(F.col("text"))).alias("terms"), F.size(listed).alias("listed"))


_IDS = r"list_filter(regexp_extract_all(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'), '[^ ]+'), lambda w: regexp_full_match(w, '[a-zA-Z][a-zA-Z0-9_]*[a-zA-Z0-9]') AND length(w) > 3 AND regexp_matches(w, '[A-Z_]'))"
_KEYS = r"list_filter(regexp_extract_all(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), '[^ ]+'), lambda w: list_contains(%s, w))" % list_sql(" ".join(text.KEYWORD_GROUPS).split())


@query(f"SELECT doc_id, len(list_distinct(list_concat({_KEYS}, list_transform({_IDS}, lambda w: lower(w))))) AS keywords FROM documents")
def technical_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.keywords(F.col("text"))).alias("keywords"))


def _neighbours(own):
    """doc_id, a and b: the f of each document (doc_id, f) and of the next one. Measures are written first, so each text is measured once and no text is moved."""
    own = materialize(own, "measures")
    return own.select("doc_id", F.col("f").alias("a")).join(own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("f").alias("b")), "doc_id")


def _pairs(spark, sf_dir, *measures):
    return _neighbours(table(spark, sf_dir, "documents").select("doc_id", F.struct(*measures).alias("f")))


_TF = lambda t: f"(SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_CONTENT(_NORM)}) AS word FROM documents) GROUP BY doc_id, word) {t}"


@query(f"""
WITH tf AS (SELECT doc_id, word, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest({_CONTENT(_NORM)}) AS word FROM documents) GROUP BY doc_id, word),
norm AS (SELECT doc_id, sqrt(sum(n * n)) AS len FROM tf GROUP BY doc_id),
dot AS (SELECT a.doc_id, sum(a.n * b.n) AS dot FROM tf a JOIN tf b ON b.doc_id = a.doc_id + 1 AND a.word = b.word GROUP BY a.doc_id)
SELECT a.doc_id, round(CASE WHEN na.len IS NULL AND nb.len IS NULL THEN 1.0 WHEN na.len IS NULL OR nb.len IS NULL THEN 0.0
  ELSE least(coalesce(dot.dot, 0) / (na.len * nb.len), 1.0) END, 6) AS similarity
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 LEFT JOIN norm na ON na.doc_id = a.doc_id LEFT JOIN norm nb ON nb.doc_id = b.doc_id LEFT JOIN dot ON dot.doc_id = a.doc_id""")
def pairwise_text_similarity(spark, sf_dir):
    t = F.col("text")
    pairs = _pairs(spark, sf_dir, text.word_digests(text.content_words(text.tokens(text.normalize(t)))).alias("words"), F.length(t).alias("n"))
    cosine = text.cosine_of_digests(F.col("a.words"), F.col("b.words"))
    return pairs.select("doc_id", F.round(text.of_lengths(cosine, F.col("a.n"), F.col("b.n")), 6).alias("similarity"))


@query(rf"""
WITH f AS (SELECT doc_id, strlen(text) AS bytes, len(list_distinct({words_sql('text')})) AS vocabulary,
  len(list_filter(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> '')) AS p,
  ((length(text) - length(replace(text, '```', ''))) // 6) AS c,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(- |\* |[0-9])'))) AS l,
  list_distinct(list_concat({_KEYS}, list_transform({_IDS}, lambda w: lower(w)))) AS k FROM documents),
r AS (SELECT a.doc_id, a.k AS ka, b.k AS kb, a.p AS pa, b.p AS pb, a.c AS ca, b.c AS cb, a.l AS la, b.l AS lb, a.bytes AS ba, b.bytes AS bb, a.vocabulary AS va, b.vocabulary AS vb FROM f a JOIN f b ON b.doc_id = a.doc_id + 1)
SELECT doc_id,
  round((CASE WHEN greatest(pa, pb) > 0 THEN 1 - abs(pa - pb) / greatest(pa, pb) ELSE 1 END + CASE WHEN greatest(ca, cb) > 0 THEN 1 - abs(ca - cb) / greatest(ca, cb) ELSE 1 END
    + CASE WHEN greatest(la, lb) > 0 THEN 1 - abs(la - lb) / greatest(la, lb) ELSE 1 END) / 3, 6) AS structure,
  round(CASE WHEN len(ka) = 0 AND len(kb) = 0 THEN 1 ELSE len(list_intersect(ka, kb)) / len(list_distinct(list_concat(ka, kb))) END, 6) AS keyword,
  round(CASE WHEN ba = 0 AND bb = 0 THEN 1 ELSE least(0.6 * CASE WHEN greatest(ba, bb) > 0 THEN least(ba, bb) / greatest(ba, bb) ELSE 1 END
    + 0.4 * CASE WHEN greatest(va, vb) > 0 THEN least(va, vb) / greatest(va, vb) ELSE 1 END, 1) END, 6) AS complexity FROM r""")
def similarity_parts(spark, sf_dir):
    t = F.col("text")
    vocabulary = F.size(F.array_distinct(text.tokens(t)))
    pairs = _pairs(spark, sf_dir, text.structure(t, "\n").alias("structure"), text.keywords(t).alias("keywords"), F.octet_length(t).alias("bytes"), vocabulary.alias("vocabulary"))
    return pairs.select(
        "doc_id",
        F.round(text.structure_similarity(F.col("a.structure"), F.col("b.structure")), 6).alias("structure"),
        F.round(text.jaccard(F.col("a.keywords"), F.col("b.keywords")), 6).alias("keyword"),
        F.round(text.of_sizes(F.col("a.bytes"), F.col("b.bytes"), F.col("a.vocabulary"), F.col("b.vocabulary")), 6).alias("complexity"),
    )


def _similarity_sql(pairs: str, enhanced: bool) -> str:
    """The weighted similarity of the pairs (l, r) of doc_ids that the SQL ``pairs`` names; texts are cut into parts once each."""
    gram = "list_distinct(list_filter(list_transform(list_zip(ws[1:len(ws) - 1], ws[2:]), lambda p: p[1] || ' ' || p[2]), lambda g: strlen(g) >= 4))"
    fields = "[" + ", ".join("(" + " OR ".join(f"contains(low, '{w}')" for w in f) + ")::INT" for f in text.SEMANTIC_FIELDS) + "]"
    listed = f"list_filter({list_sql(text.TECHNICAL_TERMS)}, lambda t: contains(low, t))"
    caps = r"list_transform(list_filter(ws, lambda w: strlen(w) > 2 AND regexp_matches(w, '^\p{Lu}')), lambda w: lower(w))"
    like = lambda x: f"CASE WHEN len(a.{x}) = 0 AND len(b.{x}) = 0 THEN 1 ELSE len(list_intersect(a.{x}, b.{x})) / len(list_distinct(list_concat(a.{x}, b.{x}))) END"
    ratio = lambda x: f"CASE WHEN greatest(a.{x}, b.{x}) > 0 THEN 1 - abs(a.{x} - b.{x}) / greatest(a.{x}, b.{x}) ELSE 1 END"
    share = lambda x: f"CASE WHEN greatest(a.{x}, b.{x}) > 0 THEN least(a.{x}, b.{x}) / greatest(a.{x}, b.{x}) ELSE 1 END"
    cosine = "CASE WHEN a.norm IS NULL AND b.norm IS NULL THEN 1.0 WHEN a.norm IS NULL OR b.norm IS NULL THEN 0.0 ELSE least(coalesce(dot, 0) / (a.norm * b.norm), 1.0) END"
    more = f"0.4 * ({like('grams')}) + 0.4 * ({like('terms')}) + 0.2 * list_sum(list_transform(list_zip(a.fields, b.fields), lambda p: p[1] * p[2])) / {len(text.SEMANTIC_FIELDS)}"
    lexical = f"CASE WHEN a.bytes > 100 AND b.bytes > 100 THEN 0.7 * ({cosine}) + 0.3 * ({more}) ELSE {cosine} END" if enhanced else cosine
    return rf"""
WITH pairs AS MATERIALIZED ({pairs}), ids AS (SELECT l AS doc_id FROM pairs UNION SELECT r FROM pairs),
n AS MATERIALIZED (SELECT doc_id, text, {words_sql(_NORM)} AS ws, lower({_NORM}) AS low FROM documents JOIN ids USING (doc_id)),
tf AS MATERIALIZED (SELECT doc_id, word, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(list_transform(ws, lambda w: lower(w))) AS word FROM n) WHERE strlen(word) >= 2 AND word NOT IN (SELECT unnest({_STOP})) GROUP BY doc_id, word),
norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM tf GROUP BY doc_id),
dots AS (SELECT l, r, sum(x.n * y.n) AS dot FROM pairs JOIN tf x ON x.doc_id = l JOIN tf y ON y.doc_id = r AND y.word = x.word GROUP BY l, r),
f AS MATERIALIZED (SELECT n.doc_id, norm, strlen(text) AS bytes, len(list_distinct({words_sql('text')})) AS vocabulary, CASE WHEN len(ws) < 2 THEN [] ELSE {gram} END AS grams,
  list_distinct(list_concat({listed}, {caps})) AS terms, {fields} AS fields, list_distinct(list_concat({_KEYS}, list_transform({_IDS}, lambda w: lower(w)))) AS k,
  len(list_filter(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g')) <> '')) AS p, ((length(text) - length(replace(text, '```', ''))) // 6) AS c,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*(- |\* |[0-9])'))) AS s FROM n LEFT JOIN norms ON norms.doc_id = n.doc_id)
SELECT pairs.l, pairs.r, round(0.4 * CASE WHEN a.bytes = 0 AND b.bytes = 0 THEN 1 WHEN a.bytes = 0 OR b.bytes = 0 THEN 0 ELSE {lexical} END
  + 0.25 * ({ratio('p')} + {ratio('c')} + {ratio('s')}) / 3 + 0.25 * ({like('k')}) + 0.1 * least(0.6 * {share('bytes')} + 0.4 * {share('vocabulary')}, 1.0), 6) AS similarity
FROM pairs JOIN f a ON a.doc_id = pairs.l JOIN f b ON b.doc_id = pairs.r LEFT JOIN dots ON dots.l = pairs.l AND dots.r = pairs.r"""


@query(f"SELECT l AS doc_id, similarity FROM ({_similarity_sql('SELECT doc_id AS l, doc_id + 1 AS r FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)', True)})")
def document_similarity(spark, sf_dir):
    own = similarity.features(table(spark, sf_dir, "documents"), sep="\n")
    return _neighbours(own).select("doc_id", F.round(similarity.compare(F.col("a"), F.col("b"), enhanced=True), 6).alias("similarity"))


# candidates of the SQL: texts whose sets of lower-cased word bigrams have a Jaccard similarity of 0.4 or more, by a join on the bigrams
_GRAM_PAIRS = rf"""SELECT l, r FROM (
  SELECT x.doc_id AS l, y.doc_id AS r, count(*) AS shared, any_value(x.n) AS nx, any_value(y.n) AS ny FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id AND least(x.n, y.n) >= 0.4 * greatest(x.n, y.n) GROUP BY 1, 2)
  WHERE shared >= 0.4 * (nx + ny - shared) - 1e-9"""
_NEAR = _similarity_sql("SELECT l, r FROM near", False)


@query(rf"""
WITH first AS MATERIALIZED (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS node FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, {words_sql('lower(' + _NORM + ')')} AS ws FROM first WHERE doc_id = node),
s AS (SELECT doc_id, CASE WHEN len(gs) > 0 THEN gs ELSE [CASE WHEN len(ws) = 1 AND strlen(ws[1]) > 1 AND NOT list_contains({_STOP}, ws[1]) THEN ws[1] ELSE '' END] END AS gs FROM
  (SELECT doc_id, ws, CASE WHEN len(ws) < 2 THEN [] ELSE list_distinct(list_filter(list_transform(list_zip(ws[1:len(ws) - 1], ws[2:]), lambda p: p[1] || ' ' || p[2]), lambda g: strlen(g) >= 4)) END AS gs FROM w)),
grams AS MATERIALIZED (SELECT doc_id, unnest(gs) AS g, len(gs) AS n FROM s), near AS MATERIALIZED ({_GRAM_PAIRS}), scored AS ({_NEAR})
SELECT l AS left_id, r AS right_id, similarity, false AS same_text FROM scored WHERE similarity >= 0.85
UNION ALL SELECT node, doc_id, 1.0, true FROM first WHERE node < doc_id""")
def near_duplicates(spark, sf_dir):
    return similarity.near_duplicates(table(spark, sf_dir, "documents"), sep="\n")


@query("""
WITH c AS (SELECT doc_id, text, greatest(ceil((length(text) - 1000) / 900.0), 0)::INT + 1 AS n FROM documents WHERE length(text) > 0)
SELECT doc_id, k AS chunk_index, n AS total_chunks, md5(substring(text, k * 900 + 1, 1000)) AS digest FROM c, unnest(range(n)) AS t(k)""")
def chunks_fixed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("chunks", chunk.fixed_chunks(F.col("text")))
    out = rows.select("doc_id", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk"))
    return out.select("doc_id", "chunk_index", "total_chunks", F.md5("chunk").alias("digest"))


@query(r"""
WITH RECURSIVE p AS (SELECT doc_id, string_split(text, chr(10)) AS ps, length(text) AS n FROM documents),
s AS (SELECT doc_id, 0 AS i, '' AS cur, NULL::VARCHAR AS done, 0 AS k FROM p WHERE n > 1000
  UNION ALL
  SELECT s.doc_id, s.i + 1,
    CASE WHEN s.i = len(ps) THEN '' ELSE (CASE WHEN length(base) > 0 THEN base || chr(10) || ps[s.i + 1] ELSE ps[s.i + 1] END) END,
    CASE WHEN s.i = len(ps) THEN nullif(s.cur, '') WHEN is_full THEN s.cur END,
    s.k + CASE WHEN s.done IS NOT NULL THEN 1 ELSE 0 END
  FROM (SELECT s.*, p.ps, (s.i < len(p.ps) AND length(s.cur) + length(p.ps[s.i + 1]) > 1000 AND length(s.cur) > 0) AS is_full,
          CASE WHEN s.i < len(p.ps) AND length(s.cur) + length(p.ps[s.i + 1]) > 1000 AND length(s.cur) > 0 THEN CASE WHEN length(s.cur) > 100 THEN right(s.cur, 100) ELSE '' END ELSE s.cur END AS base
        FROM s JOIN p ON s.doc_id = p.doc_id WHERE s.i <= len(p.ps)) s)
SELECT doc_id, k AS chunk_index, md5(done) AS digest FROM s WHERE done IS NOT NULL
UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 1000""")
def chunks_paragraph(spark, sf_dir):
    chunks = chunk.paragraph_chunks(F.col("text"), sep="\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.md5("chunk").alias("digest"))


_IMPORTANT = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in text.IMPORTANT_WORDS)


@query(rf"""
SELECT doc_id, list_aggregate(list_transform(list_filter({words_sql('text')}, lambda w: strlen(w) > 3)[1:10], lambda w: lower(w)), 'string_agg', ' ') AS keywords,
  round(least(least(strlen(text) / 1000.0, 0.3) + 0.1 * ({_IMPORTANT}), 1.0), 6) AS importance FROM documents""")
def chunk_keywords_importance(spark, sf_dir):
    words = chunk.chunk_keywords(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.size(words) > 0, F.array_join(words, " ")).alias("keywords"), F.round(chunk.importance(F.col("text")), 6).alias("importance"))


@query("""
WITH c AS (SELECT strlen(substring(text, k * 900 + 1, 1000)) AS n FROM (SELECT text, greatest(ceil((length(text) - 1000) / 900.0), 0)::INT + 1 AS m FROM documents WHERE length(text) > 0), unnest(range(m)) AS t(k))
SELECT count(*) FILTER (n <= 1000) AS stored, count(*) FILTER (n > 1000) AS skipped, count(*) AS chunks FROM c""")
def chunk_summary(spark, sf_dir):
    from lodestone.operators.store import chunk_summary as summary

    chunks = table(spark, sf_dir, "documents").select(F.explode(chunk.fixed_chunks(F.col("text"))).alias("chunk"))
    return summary(chunks, limit=1000)


_LETTERS = rf"list_filter(list_transform({words_sql('lower(text)')}, lambda w: regexp_replace(w, '[^\p{{L}}]', '', 'g')), lambda w: w <> '')"
_SENT = r"list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g')) <> '')"


@query(rf"""
WITH w AS (SELECT doc_id, len({words_sql('text')}) AS words, len({_SENT}) AS sentences,
  coalesce(list_sum(list_transform({_LETTERS}, lambda w: greatest(len(regexp_extract_all(w, '[aeiouy]+')), 1)
    - CASE WHEN suffix(w, 'e') AND greatest(len(regexp_extract_all(w, '[aeiouy]+')), 1) > 1 THEN 1 ELSE 0 END)), 0) AS syllables FROM documents)
SELECT doc_id, words, sentences, syllables::BIGINT AS syllables, round(CASE WHEN words = 0 OR sentences = 0 THEN 0.0
  ELSE least(greatest(206.835 - 1.015 * words / sentences - 84.6 * syllables / words, 0.0), 100.0) / 100 END, 6) AS readability FROM w""")
def readability(spark, sf_dir):
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", text.word_count(t).alias("words"), quality.sentence_count(t).alias("sentences"), quality.syllables(t).alias("syllables"))
    return rows.withColumn("readability", F.round(quality.flesch(F.col("words"), F.col("sentences"), F.col("syllables")), 6))


_TRANS = " + ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)}" for w in quality.TRANSITIONS)


@query(rf"""
WITH s AS (SELECT doc_id, text, {_SENT} AS ss FROM documents),
f AS (SELECT doc_id, text, len(ss) AS n, list_transform(ss, lambda s: list_distinct(list_filter(list_transform({words_sql('s')}, lambda w: regexp_replace(lower(w), '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')), lambda w: strlen(w) > 2))) AS sets FROM s),
j AS (SELECT doc_id, text, n, list_transform(list_filter(list_zip(sets[1:n - 1], sets[2:]), lambda p: len(p[1]) > 0 AND len(p[2]) > 0), lambda p: len(list_intersect(p[1], p[2])) / len(list_distinct(list_concat(p[1], p[2])))) AS likes FROM f)
SELECT doc_id, round(CASE WHEN n < 2 THEN 0.5 ELSE (CASE WHEN len(likes) > 0 THEN list_sum(likes) / len(likes) ELSE 0 END) + least(({_TRANS}) / n, 0.3) END, 6) AS coherence FROM j""")
def coherence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.coherence(F.col("text")), 6).alias("coherence"))


@query(rf"""
WITH w AS (SELECT doc_id, {words_sql('text')} AS ws, len(regexp_split_to_array(text, '[.!?]')) AS parts, len(string_split(text, chr(10))) AS ps FROM documents),
n AS (SELECT doc_id, len(ws) AS n, parts, ps, CASE WHEN len(ws) > 0 THEN len(list_distinct(list_transform(ws, lambda x: lower(x)))) / len(ws) ELSE 0 END AS d FROM w)
SELECT doc_id, round(((n > 50)::INT * 10 + (n > 200)::INT * 10 + (n > 500)::INT * 10 + (parts > 3)::INT * 10 + (ps > 1)::INT * 10
  + (n / parts > 5 AND n / parts < 25)::INT * 20 + (d > 0.3)::INT * 20) / 100.0, 6) AS score FROM n""")
def content_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.content_score(F.col("text"), "\n"), 6).alias("score"))


_TECH = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in quality.TECHNICAL_WORDS)


@query(f"SELECT doc_id, round(({_TECH}) / {len(quality.TECHNICAL_WORDS)}, 6) AS technical FROM documents")
def technical_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.technical_score(F.col("text")), 6).alias("technical"))


@query("""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents)
SELECT doc_id, md5(line) AS line_md5, count(*) AS n FROM l WHERE strlen(line) > 10 GROUP BY doc_id, line HAVING count(*) > 2""")
def repeated_lines(spark, sf_dir):
    return profile.repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", F.md5("line").alias("line_md5"), "n")


# SQL with the engine's table functions, run by spark.sql over views of the tables
def _views(spark, sf_dir, *names):
    table_functions.register(spark)
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"lodestone_{name}")


@query("""
WITH c AS (SELECT doc_id, text, greatest(ceil((length(text) - 1000) / 900.0), 0)::INT + 1 AS n FROM documents WHERE length(text) > 0)
SELECT doc_id, k::INT AS chunk_index, md5(substring(text, k * 900 + 1, 1000)) AS digest FROM c, unnest(range(n)) AS t(k)""")
def sql_text_chunks(spark, sf_dir):
    _views(spark, sf_dir, "documents")
    return spark.sql("SELECT doc_id, chunk_index, md5(chunk) AS digest FROM lodestone_documents, LATERAL text_chunks(text, 1000, 100)")


@query(r"""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS started, floor(epoch(max(ts)))::BIGINT AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def sql_event_sessions(spark, sf_dir):
    _views(spark, sf_dir, "events")
    return spark.sql("SELECT user_id, unix_timestamp(started) AS started, unix_timestamp(ended) AS ended, n FROM event_sessions(TABLE(SELECT user_id, cast(ts AS timestamp) AS ts FROM lodestone_events), 6 * 3600)")


@query(r"""SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]+)"', 1)) AS target FROM pages) WHERE NOT regexp_matches(target, '^(#|javascript:|mailto:)') GROUP BY page_id""")
def sql_page_links(spark, sf_dir):
    _views(spark, sf_dir, "pages")
    return spark.sql("SELECT page_id, count(*) AS links FROM lodestone_pages, LATERAL page_links(html, url) GROUP BY page_id")


@query(f"""
WITH r AS ({ORACLES['readability']}), c AS ({ORACLES['coherence']}), t AS ({ORACLES['technical_score']})
SELECT d.doc_id, round(0.3 * readability + 0.2 * coherence + 0.2 * (CASE WHEN length(source) > 0 THEN 0.2 ELSE 0 END + CASE WHEN strlen(text) > 200 THEN 0.3 ELSE 0 END + CASE WHEN lang IS NOT NULL THEN 0.15 ELSE 0 END) + 0.15 * 0.5 + 0.15 * technical, 4) AS overall
FROM documents d JOIN r ON r.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id JOIN t ON t.doc_id = d.doc_id""")
def overall_quality(spark, sf_dir):
    """All of a document's quality measures weighted into one."""
    t, none = F.col("text"), F.array().cast("array<string>")
    readable = quality.flesch(text.word_count(t), quality.sentence_count(t), quality.syllables(t))
    complete = quality.completeness(F.col("source"), t, none, F.lit(None).cast("string"), F.col("lang"))
    measures = [F.round(m, 6) for m in (readable, quality.coherence(t), complete, quality.relevance(none, none, none), quality.technical_score(t))]
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.overall(*measures), 4).alias("overall"))
