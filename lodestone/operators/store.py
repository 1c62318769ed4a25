"""The document store as tables: every change is a DataFrame from the old table to the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OVERSIZE = 10_000


def snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Old snapshots may lack columns of newer ones."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def get(docs: DataFrame, key, id_column: str = "doc_id") -> DataFrame:
    return docs.where(F.col(id_column) == F.lit(key))


def page(docs: DataFrame, offset: int, limit: int, id_column: str = "doc_id") -> DataFrame:
    return docs.orderBy(id_column).offset(offset).limit(limit)


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(w)).where("__row = 1").drop("__row")


def insert_absent(docs: DataFrame, new: DataFrame, order: list, id_column: str = "doc_id") -> DataFrame:
    """Rows of ``new`` whose id is not there yet; of equal ids within ``new`` the first by ``order``."""
    fresh = first_wins(new, [id_column], order).join(docs.select(id_column), id_column, "left_anti")
    return docs.unionByName(fresh.select(docs.columns))


def insert_status(docs: DataFrame, new: DataFrame, *, id_column: str = "doc_id", content: str = "text") -> DataFrame:
    """New rows with what becomes of them: blank, existing or added."""
    known = docs.select(F.col(id_column).alias("__known")).distinct()
    status = F.when(F.length(F.trim(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"\s+", " "))) == 0, "blank").when(F.col("__known").isNotNull(), "existing").otherwise("added")
    return new.join(known, F.col(id_column) == F.col("__known"), "left").withColumn("status", status).drop("__known")


def delete(docs: DataFrame, key, id_column: str = "doc_id") -> DataFrame:
    return docs.where(~F.col(id_column).eqNullSafe(F.lit(key)))


def replace(docs: DataFrame, new: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """New contents under old ids; ``created_at`` is kept where both have it."""
    rows = new
    if "created_at" in docs.columns and "created_at" in new.columns:
        old = docs.select(id_column, F.col("created_at").alias("__created"))
        rows = new.join(old, id_column, "left").withColumn("created_at", F.coalesce("__created", "created_at")).drop("__created")
    return docs.join(new.select(id_column), id_column, "left_anti").unionByName(rows.select(docs.columns))


def unprocessed(versions: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    return versions.join(processed, keys, "left_anti")


def chunk_summary(chunks: DataFrame, column: str = "chunk", limit: int = OVERSIZE) -> DataFrame:
    size = F.octet_length(column)
    return chunks.agg(F.count_if(size <= limit).alias("stored"), F.count_if(size > limit).alias("skipped"), F.count("*").alias("chunks"))


def stats(docs: DataFrame, language: str, package: str, version: str) -> DataFrame:
    return docs.groupBy(language, package).agg(F.count("*").alias("documents"), F.count_distinct(version).alias("versions"))


def fallback(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """For each key the rows of the first source that has any."""
    tagged = [s.withColumn("__source", F.lit(k)) for k, s in enumerate(sources)]
    rows = tagged[0]
    for s in tagged[1:]:
        rows = rows.unionByName(s)
    best = F.min("__source").over(Window.partitionBy(*keys))
    return rows.withColumn("__best", best).where("__source = __best").drop("__source", "__best")


def exists(docs: DataFrame, condition) -> bool:
    return docs.where(condition).limit(1).count() > 0


def files(docs: DataFrame, keys: dict, path: str = "file_path") -> DataFrame:
    """The distinct paths of a package's fragments; ``keys``: column to value."""
    out = docs
    for column, value in keys.items():
        out = out.where(F.col(column) == value)
    return out.select(path).distinct()


def delete_package(docs: DataFrame, keys: dict) -> DataFrame:
    """All but the rows in which every key column has its value; a null is not equal to any."""
    match = F.lit(True)
    for column, value in keys.items():
        match = match & F.col(column).eqNullSafe(F.lit(value))
    return docs.where(~match)


def write_both(docs: DataFrame, path: str, *, id_column: str = "doc_id", column: str = "text", vector: str = "embedding") -> tuple[str, str]:
    """One write to two tables: terms (sorted by term) and vectors. Both go to a new folder that one marker shows to readers
    (``publish.read(spark, path, "terms")``), so these see both of one write or both of the one before."""
    from lodestone.operators.ingest import inverted_index
    from lodestone.operators.publish import publish

    terms = inverted_index(docs, id_column=id_column, column=column)
    folder = publish(docs.sparkSession, path, {"terms": terms, "vectors": docs.select(id_column, vector)}, sort={"terms": ["term"]})
    return f"{folder}/terms", f"{folder}/vectors"
