"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark decontamination, tokens.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each stage's result as Parquet to the shared folder and reads it
back as the next stage's input, so a lost executor never costs more than the stage at work; what a stage has read is deleted then.

The near-duplicate stage links texts whose five-word shingles have a Jaccard similarity of 0.8 or more. Its candidates are op8's (SimHash
fingerprints within four bits) and, since at 0.8 fingerprints differ in some ten bits, those of an exact set-similarity join.

Defined results: rows without doc_id are not kept by the near-duplicate stage; of rows that repeat a
doc_id one stays there; extra columns of the input are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, near_copies, queries, substring, toxicity
from lodestone.runtime import discard, materialize

SHINGLE, LEAST = 5, 0.8  # words a shingle, least Jaccard similarity of near copies
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar scores below its threshold; labels are learned as in op3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~queries.held_out())
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, keep=COLUMNS[1:]).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of texts linked by a Jaccard similarity of 0.8 over five-word shingles."""
    first = near_copies.classes(docs, width=SHINGLE, least=LEAST).where("doc_id = component_id").select("doc_id")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    kept = docs.join(first, "doc_id", "left_semi").withColumn("__row", F.row_number().over(one))
    return kept.where("__row = 1").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start in an earlier document; what has no word left goes."""
    found = substring.remove_repeats(docs, keep=("lang", "source"), untouched=True)
    left = found.where("n_words = 0 or n_removed < n_words")
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.annotate(docs, items, keep=COLUMNS[1:]).where("n_hit = 0").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, with their digest and the decoded text's."""
    import public_tokenizers

    path = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, ids=True, digests=True, keep=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None  # SQL expresses neither the learned grammar nor the encoding


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
