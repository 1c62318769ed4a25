"""Fragments of files to stored records: blank check, duplicate decision, record, vector metadata; searching with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import keywords
from lodestone.functions.vectors import mock_embedding
from lodestone.operators import profile, search
from lodestone.operators.similarity import duplicate_decision
from lodestone.operators.store import first_wins


def fragment_id(language: Column, package: Column, version: Column, path: Column) -> Column:
    return F.concat_ws("/", language, package, version, path)


def records(fragments: DataFrame, embed=None, *, dimension: int = 8) -> DataFrame:
    """Records of fragments (language, package_name, version, file_path, content): id, title (the file's stem), doc_type, metadata, embedding.

    ``embed``: a function of the content column; without one a deterministic stand-in.
    """
    path = F.col("file_path")
    folders = F.filter(F.split(profile.folder(path), "/"), lambda x: x != "")
    vector = (embed or mock_embedding(dimension))(F.col("content"))
    return fragments.select(
        fragment_id(F.col("language"), F.col("package_name"), F.col("version"), path).alias("id"),
        F.coalesce(F.nullif(profile.file_stem(path), F.lit("")), F.lit("Unknown Title")).alias("title"),
        "language", "package_name", "version", "content",
        F.lower(profile.file_type(path)).alias("doc_type"),
        F.create_map(F.lit("file_path"), path, F.lit("hierarchy_path"), F.array_join(folders, "/")).alias("metadata"),
        vector.alias("embedding"),
    )


def ingest(stored: DataFrame, fragments: DataFrame, *, embed=None, dimension: int = 8) -> tuple[DataFrame, DataFrame]:
    """(the store after it, id and status of each fragment: blank, duplicate, replaced or added).

    A fragment is a duplicate if the store holds its id, in the same version, with a text as similar as the duplicate threshold; else it replaces that.
    Of fragments with one id the last by content counts. Only kept fragments are embedded.
    """
    keyed = fragments.withColumn("id", fragment_id(F.col("language"), F.col("package_name"), F.col("version"), F.col("file_path")))
    one = first_wins(keyed, ["id"], [F.desc("content")])
    old = stored.select("id", "version", "content")
    decided = duplicate_decision(old, one, ["id"]).join(old.select("id", F.lit(True).alias("__there")), "id", "left")
    blank = F.coalesce(F.length(F.trim(F.regexp_replace("content", r"\s+", " "))), F.lit(0)) == 0
    status = F.when(blank, "blank").when(F.col("duplicate"), "duplicate").when(F.col("__there"), "replaced").otherwise("added")
    decided = decided.withColumn("status", status)
    fresh = records(decided.where("status in ('replaced', 'added')"), embed, dimension=dimension)
    after = stored.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)
    return after, decided.select("id", "status")


def vector_metadata(fragments: DataFrame) -> DataFrame:
    """doc_id, path, hierarchy, keywords, content_hash (MD5) and content_length (bytes) beside a vector."""
    return fragments.select(
        fragment_id(F.col("language"), F.col("package_name"), F.col("version"), F.col("file_path")).alias("doc_id"),
        "file_path",
        F.filter(F.split(profile.folder(F.col("file_path")), "/"), lambda x: x != "").alias("hierarchy_path"),
        keywords(F.col("content")).alias("keywords"),
        F.md5("content").alias("content_hash"),
        F.octet_length("content").alias("content_length"),
    )


def within_hierarchy(
    fragments: DataFrame, *, language: str | None = None, package: str | None = None, version: str | None = None, prefix: str | None = None, level: int | None = None,
    file_type: str | None = None, threshold: float | None = None, limit: int | None = None, order=(),
) -> DataFrame:
    """All given restrictions hold together; ``prefix`` is of file_path, ``level`` the number of folders, ``threshold`` of the column score."""
    out = fragments
    for column, value in (("language", language), ("package_name", package), ("version", version), ("file_type", file_type)):
        out = out if value is None else out.where(F.col(column) == value)
    if prefix is not None:
        out = out.where(F.startswith("file_path", F.lit(prefix)))
    if level is not None:
        out = out.where(F.size("hierarchy_path") == level)
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def final_score(similarity: Column, relevance: Column) -> Column:
    return (similarity + relevance) / 2


def search_or_fallback(stored: DataFrame, chunks: DataFrame, query_vector: list[float], k: int = 3, *, id_column: str = "vec_id") -> DataFrame:
    """The k best stored vectors; only where there are none, the k chunks of highest cosine. ``branch`` says which, ``best_match`` marks the first."""
    first = search.knn(stored, query_vector, k, id_column=id_column).withColumn("branch", F.lit("stored"))
    second = search.knn(chunks, query_vector, k, metric="cosine", id_column=id_column).withColumn("branch", F.lit("temporary"))
    rows = first.unionByName(second)  # at most 2k
    chosen = rows.agg(F.min("branch").alias("branch"))
    out = rows.join(F.broadcast(chosen), "branch")
    return out.withColumn("best_match", F.row_number().over(Window.orderBy(F.desc("score"), id_column)) == 1)


def is_cached(hits: DataFrame, language: str, package: str, least: float = 0.8) -> Column:
    """Over a search's hits (score, language, package_name): whether one is the package, close enough."""
    return F.coalesce(F.bool_or((F.col("score") >= least) & (F.lower("package_name") == package.lower()) & (F.lower("language") == language.lower())), F.lit(False))


def formatted(results: DataFrame, *, order: list, title: str = "title", content: str = "content") -> DataFrame:
    """One text: the results numbered in markdown. For a page of results, not for a table."""
    numbered = results.select(F.row_number().over(Window.orderBy(*order)).alias("n"), title, content)
    line = F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), F.col(title), F.lit("\n"), F.col(content))
    rows = numbered.agg(F.array_sort(F.collect_list(F.struct("n", line.alias("t")))).alias("rows"))
    return rows.select(F.array_join(F.transform("rows", lambda r: r["t"]), "\n\n").alias("report"))


def scatter(positions: DataFrame, results: DataFrame, *, key: str, position: str = "position") -> DataFrame:
    """Results of distinct keys back at every position that asked for them; null where there is none."""
    return positions.join(results, key, "left").select(position, key, *[c for c in results.columns if c != key])


def inverted_index(docs: DataFrame, *, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """term, id, n of the words between white space, lower-cased: what a full-text index is built from."""
    words = F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != "")
    return docs.select(id_column, F.explode(words).alias("term")).groupBy("term", id_column).agg(F.count("*").alias("n"))


def cached_versions(asked: DataFrame, cache: DataFrame, source: DataFrame, *, as_of, ttl_seconds: int) -> DataFrame:
    """key, versions, origin for each key: a fresh cache entry, else the source's, else a stale entry, else none.

    ``cache``: key, versions, cached_at; ``source``: key, versions of the keys that the source answers.
    """
    held = cache.select("key", F.col("versions").alias("held"), "cached_at")
    given = source.select("key", F.col("versions").alias("given"))
    fresh = F.coalesce(F.lit(as_of).cast("timestamp_ntz") - F.col("cached_at") <= F.make_dt_interval(secs=F.lit(ttl_seconds)), F.lit(False))
    rows = asked.join(held, "key", "left").join(given, "key", "left")
    origin = F.when(fresh, "cache").when(F.col("given").isNotNull(), "source").when(F.col("held").isNotNull(), "stale").otherwise("none")
    return rows.withColumn("origin", origin).select("key", F.when(F.col("origin") == "source", F.col("given")).when(F.col("origin") != "none", F.col("held")).alias("versions"), "origin")
