"""The registered queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, langid, merkle, piece_bpe, repair, simhash, substring, tokenfile, toxicity, turn_trie, urlfilter, warc
from lodestone.runtime import scratch_path

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    archive = warc.write(pages)
    return warc.read(archive, warc.look_up(archive, pages.where("page_id is not null"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.fingerprint_with_edit(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        merkle.to_string(F.col("tree")).alias("fingerprint"),
        merkle.to_string(F.col("edited_tree")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.size(merkle.differing(F.col("tree"), F.col("edited_tree"))).alias("n_differing"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), rules)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.annotate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(
        _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, digests=True
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out())
    return langid.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    tokenfile.write(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), out)
    return tokenfile.offsets(tokenfile.read(spark, out))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ids=False, digests=True)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair.digest(repair.repair(repair.damage(conversations)), conversations)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.nodes(*turn_trie.rebuilt(turn_trie.sequences(_table(spark, sf_dir, "conversations"))))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from lodestone.llm.oracles import ORACLES

    return dict(ORACLES)
