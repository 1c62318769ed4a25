"""Vector, keyword and fused search.

Exact nearest neighbours of many queries: each Arrow batch of stored vectors meets all query vectors in one matrix product, what can be among the
first k is computed exactly, and the batch keeps its own top k, which the shuffle then merges, so k rows a query and batch move. The query side is checked
against a bound before it is sent to the tasks; larger query sets are cut into portions of that size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULT, Config
from lodestone.functions.text import literal_array, word_count
from lodestone.functions.vectors import cosine, l2_distance
from lodestone.runtime import materialize, ship_package


def knn(vectors: DataFrame, query: list[float], k: int = 10, *, metric: str = "l2", id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, score of the k nearest: 1 / (1 + distance), or the cosine. Ties by id."""
    wanted = F.array(*[F.lit(float(x)) for x in query])
    own = F.col(column)
    score = F.try_divide(F.lit(1.0), 1 + l2_distance(own, wanted)) if metric == "l2" else cosine(own, wanted)
    scored = vectors.select(F.col(id_column), F.round(score, 6).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def nearest_scores(queries: np.ndarray, vectors: np.ndarray, k: int, apart: np.ndarray | None = None) -> np.ndarray:
    """1 / (1 + distance), to six places, of each query (row) and vector (column) that can be among the query's first k; -inf for others.

    A matrix product on centred vectors gives all distances with a bound of their error, which says what is computed once more, from
    differences. Pairs that are ``apart`` do not count.
    """
    centre = queries.mean(0)
    a, b = queries - centre, vectors - centre
    squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None]
    near = squares - 2 * a @ b.T
    error = squares * (4 * (queries.shape[1] + 8) * np.finfo(np.float64).eps) + np.finfo(np.float64).tiny
    least, most = (1 / (1 + np.sqrt(np.maximum(near + e, 0))) for e in (error, -error))
    if apart is not None:
        least[apart] = most[apart] = -np.inf
    limit = np.partition(least, -k, axis=1)[:, -k] if k < least.shape[1] else np.full(len(least), -np.inf)
    rows, columns = np.nonzero((most >= limit[:, None] - 2e-6) & (most > -np.inf))  # scores that round to the same are ties
    out = np.full(near.shape, -np.inf)
    for at in range(0, len(rows), 20_000):
        i, j = rows[at : at + 20_000], columns[at : at + 20_000]
        out[i, j] = np.round(1 / (1 + np.sqrt(((queries[i] - vectors[j]) ** 2).sum(1))), 6)
    return out


def knn_batch(
    vectors: DataFrame, queries: DataFrame, k: int = 10, *, metric: str = "l2", id_column: str = "vec_id", column: str = "embedding",
    exclude_self: bool = False, config: Config = DEFAULT, depth: int = 0,
) -> DataFrame:
    """query_id, id, score, rank of the k nearest of each row of ``queries`` (query_id, query)."""
    ship_package(vectors.sparkSession)
    n = queries.count()
    if n > config.max_sent_vectors:
        if depth > 20:
            raise ValueError("more rows of one query_id than max_sent_vectors")
        # each depth deals by another hash: a hash that has dealt rows here cannot part them again
        portions = -(-n // config.max_sent_vectors)
        bucket = F.pmod(F.xxhash64("query_id", F.lit(depth)), F.lit(portions))
        some = [
            knn_batch(vectors, queries.where(bucket == b), k, metric=metric, id_column=id_column, column=column, exclude_self=exclude_self, config=config, depth=depth + 1)
            for b in range(portions)
        ]
        return reduce(DataFrame.unionByName, some)
    rows = queries.where("query is not null").select("query_id", "query").collect()
    by_size: dict[int, tuple[list, list]] = {}
    for r in rows:
        ids, own = by_size.setdefault(len(r["query"]), ([], []))
        ids.append(r["query_id"])
        own.append(r["query"])
    sent = vectors.sparkSession.sparkContext.broadcast({d: (np.array(i, np.int64), np.array(v, np.float64)) for d, (i, v) in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column_ = batch.column(1)
            sizes = np.diff(column_.offsets.to_numpy()) if len(column_) else np.zeros(0, int)
            ids = batch.column(0).to_numpy()
            for d, (query_ids, queries_) in sent.value.items():
                at = np.flatnonzero(sizes == d)
                if not len(at):
                    continue
                flat = column_.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                for start in range(0, len(queries_), 512):
                    own = queries_[start : start + 512]
                    apart = query_ids[start : start + 512][:, None] == ids[at][None] if exclude_self else None
                    if metric == "l2":
                        score = nearest_scores(own, flat, k, apart)
                    else:
                        norms = np.sqrt((own**2).sum(1))[:, None] * np.sqrt((flat**2).sum(1))[None]
                        score = np.round(np.where(norms > 0, own @ flat.T / np.where(norms > 0, norms, 1), 0.0), 6)
                        if apart is not None:
                            score[apart] = -np.inf
                    keep = min(k, len(at))
                    order = np.lexsort((np.broadcast_to(ids[at], score.shape), -score), axis=1)[:, :keep]
                    q = np.repeat(query_ids[start : start + 512], keep)
                    s = np.take_along_axis(score, order, 1).reshape(-1)
                    good = s > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(q[good]), pa.array(ids[at][order.reshape(-1)][good]), pa.array(s[good])], names=["query_id", "id", "score"])

    near = vectors.where(F.col(column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), column).mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_lsh(vectors: DataFrame, query: list[float], k: int = 10, *, bucket_length: float = 2.0, tables: int = 4, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Approximate neighbours by bucketed random projections; recall is to be measured against ``knn``."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.select(id_column, array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=7).fit(rows)
    found = model.approxNearestNeighbors(rows, Vectors.dense(query), k, distCol="distance")
    return found.select(id_column, F.round(1 / (1 + F.col("distance")), 6).alias("score"))


def hybrid_score(score: Column, query: str, *, title: Column, content: Column, language: Column, package: Column, doc_type: Column, config: Config = DEFAULT) -> Column:
    """Vector score 0.6, keywords 0.3, context 0.1 each for language and package named in the query; types 0.05.

    An empty language or package is not taken for named.
    """
    lower = query.lower()
    words = sorted({w for w in lower.split() if len(w.encode()) > 2})
    t, c = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    total = F.lit(0.0)
    for w in words:
        own = F.when(F.contains(t, F.lit(w)), 0.6).otherwise(0.0) + F.when(F.contains(c, F.lit(w)), 0.4).otherwise(0.0)
        own = own + F.when(F.contains(c, F.lit(f" {w} ")) | F.contains(t, F.lit(f" {w} ")), 0.2).otherwise(0.0)
        total = total + F.least(own, F.lit(1.0))
    named = lambda x: F.when((F.length(x) > 0) & F.contains(F.lit(lower), F.lower(x)), config.context_bonus).otherwise(0.0)
    typed = lambda word: F.when(F.lit(word in lower) & F.contains(doc_type, F.lit(word)), config.type_bonus).otherwise(0.0)
    vector, keyword = config.hybrid_weights
    out = vector * score + keyword * total / max(1, len(words))
    for bonus in (named(language), named(package), typed("api"), typed("tutorial")):
        out = out + F.coalesce(bonus, F.lit(0.0))
    return out


def hybrid_search(docs: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], k: int = 10, *, doc_id: str = "doc_id", vec_id: str = "vec_id", config: Config = DEFAULT) -> DataFrame:
    """Twice k nearest vectors, joined to their documents (those without one drop out), rescored, the best k.

    ``docs`` has title, content, language, package_name, doc_type.
    """
    near = knn(vectors, query_vector, 2 * k, id_column=vec_id).withColumnRenamed("score", "similarity")
    joined = F.broadcast(near).join(docs, near[vec_id] == docs[doc_id])  # at most 2k rows are sent
    score = hybrid_score(F.col("similarity"), query, title=F.col("title"), content=F.col("content"), language=F.col("language"), package=F.col("package_name"), doc_type=F.col("doc_type"), config=config)
    return joined.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), doc_id).limit(k)


def bm25(docs: DataFrame, query: str, k: int = 10, *, id_column: str = "doc_id", column: str = "text", config: Config = DEFAULT) -> DataFrame:
    """id, score of the k best by BM25 over white-space words.

    The texts are read once, for each document's number of words and of each term; that narrow table is written and
    read twice, for the corpus counts (one row) and the scores.
    """
    terms = sorted(set(query.lower().split()))
    lower = F.lower(F.col(column))
    pattern = r"(?<!\S)(?:" + "|".join(re.escape(t) for t in terms) + r")(?!\S)"
    own = docs.select(id_column, word_count(lower).alias("n"), F.regexp_extract_all(lower, F.lit(pattern), F.lit(0)).alias("hits"))
    times = lambda term: F.size(F.filter("hits", lambda w: w == term))
    counted = materialize(own.select(id_column, "n", *[times(t).alias(f"f{i}") for i, t in enumerate(terms)]), "term-counts")
    corpus = counted.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    both = counted.crossJoin(F.broadcast(corpus))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        f = F.col(f"f{i}")
        score = score + idf * f * (config.bm25_k1 + 1) / (f + config.bm25_k1 * (1 - config.bm25_b + config.bm25_b * F.col("n") / F.col("mean")))
    return both.select(id_column, F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), id_column).limit(k)


def fuse(full_text: DataFrame, semantic: DataFrame, k: int = 10, *, id_column: str = "doc_id", weight: float = DEFAULT.semantic_weight) -> DataFrame:
    """Full outer join of two result sets (id, score): missing scores are 0; FullText, Semantic or Hybrid."""
    a = full_text.select(F.col(id_column), F.col("score").alias("text_score"))
    b = semantic.select(F.col(id_column), F.col("score").alias("semantic_score"))
    kind = F.when(F.col("text_score").isNull(), "Semantic").when(F.col("semantic_score").isNull(), "FullText").otherwise("Hybrid")
    joined = a.join(b, id_column, "full_outer").withColumn("match", kind).na.fill(0.0, ["text_score", "semantic_score"])
    score = F.round((1 - weight) * F.col("text_score") + weight * F.col("semantic_score"), 6)
    return joined.withColumn("score", score).orderBy(F.desc("score"), id_column).limit(k)


def filtered(docs: DataFrame, *, languages=None, doc_types=None, threshold: float | None = None, limit: int | None = None, language="language", doc_type="doc_type", order=None) -> DataFrame:
    """All filters are optional and hold together."""
    out = docs
    if languages:
        out = out.where(F.col(language).isin(list(languages)))
    if doc_types:
        out = out.where(F.col(doc_type).isin(list(doc_types)))
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    if order:
        out = out.orderBy(*order)
    return out.limit(limit) if limit is not None else out


def substring_score(title: Column, content: Column, query: str) -> Column:
    hit = F.contains(F.lower(title), F.lit(query.lower())) | F.contains(F.lower(content), F.lit(query.lower()))
    return F.when(hit, 0.8).otherwise(0.1)


def relevance(content: Column, query: str, language: Column, expected: str) -> Column:
    words, lower = query.lower().split(), F.lower(content)
    matched = sum((F.contains(lower, F.lit(w)).cast("int") for w in words), F.lit(0))
    score = F.when(language == expected, 0.3).otherwise(0.0)
    score = score + (0.5 * matched / len(words) if words else 0.0)
    score = score + F.when(F.octet_length(content) > 100, 0.1).otherwise(0.0) + F.when(F.octet_length(content) > 500, 0.1).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def matched_keywords(content: Column, query: str) -> Column:
    return F.filter(literal_array(query.lower().split()), lambda w: F.contains(F.lower(content), w))


def preview(content: Column, query: str, length: int = 200) -> Column:
    """The first sentence with the query that has more than 20 bytes, else the start; cut by characters."""
    trimmed = F.transform(F.filter(F.split(content, r"\."), lambda s: F.contains(F.lower(s), F.lit(query.lower()))), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    hit = F.get(F.filter(trimmed, lambda s: F.octet_length(s) > 20), 0)
    chosen = F.coalesce(hit, content)
    return F.when(F.length(chosen) > length, F.concat(F.left(chosen, F.lit(length)), F.lit("..."))).otherwise(chosen)


def expand_query(query: Column, language: Column) -> Column:
    """Adds the language's words to the query."""
    synonyms = {"rust": "rust crate cargo", "python": "python pip package", "javascript": "javascript npm node", "go": "go module pkg", "java": "java maven jar"}  # fixed values
    out = F.lit(None).cast("string")
    for name, words in synonyms.items():
        out = F.when(language == name, F.lit(words)).otherwise(out)
    return F.concat_ws(" ", query, out)


def rerank(hits: DataFrame, threshold: float = 0.5, k: int = 10, *, id_column: str = "doc_id") -> DataFrame:
    return hits.where(F.col("score") >= threshold).orderBy(F.desc("score"), id_column).limit(k)


def weighted(vector_score: Column, text_score: Column, vector_weight: float = 0.7, text_weight: float = 0.3) -> Column:
    """Caller's weights; a missing score counts 0."""
    return vector_weight * F.coalesce(vector_score, F.lit(0.0)) + text_weight * F.coalesce(text_score, F.lit(0.0))
