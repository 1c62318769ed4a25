"""Strings that are no UTF-8, many benchmark items, and a payload that most pages share."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontam, queries, warc

TEXTS = ["6162FF63 2064", "C328", "E28228A1", "616263", ""]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("bytes"))
    rows = spark.createDataFrame([(k, t.replace(" ", "")) for k, t in enumerate(TEXTS * 3)], "doc_id long, hex string")
    docs = rows.select("doc_id", F.unhex("hex").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    docs.write.parquet(f"{out}/documents.parquet")
    docs.select((F.col("doc_id") % 4).alias("conv_id"), F.col("doc_id").alias("turn"), F.col("text").alias("role"), "text").write.parquet(f"{out}/conversations.parquet")
    docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.col("text").alias("html")).write.parquet(f"{out}/pages.parquet")
    docs.select(F.col("doc_id").alias("item_id"), "text").where("doc_id = 0").write.parquet(f"{out}/benchmark.parquet")
    docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(f"{out}/labels.parquet")
    return out


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_bytes_that_are_no_utf8_have_results(spark, folder, name):
    rows = queries.queries()[name](spark, folder).collect()
    assert len(rows) == 4 if name.startswith("op12_") else len(rows) >= 5 if name.startswith("op13_") else len(rows) == 15


def test_pipeline_takes_such_bytes(spark, folder):
    import corpus_pipeline

    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} <= set(range(15))


def test_many_items_are_sieved_and_found_alike(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 4, 9, 10, 25])))) for k in range(400)]
    plain = [" ".join(word() for _ in range(rng.randrange(200))) for _ in range(150)]
    docs = [(k, f"{t} {rng.choice(items)[1]} {t[:50]}" if k % 3 == 0 else t) for k, t in enumerate(plain)] + [(7, None), (None, items[3][1]), (151, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("keep", F.lit("k"))
    i = spark.createDataFrame(items, "item_id long, text string")
    show = lambda df: sorted((str(r) for r in df.collect()))
    one = decontam.annotate(d, i, keep=("keep",))
    assert show(decontam.annotate(d, i, keep=("keep",), shard_bytes=900)) == show(one)
    longer = i.where(F.size(F.split("text", " ")) > 9)
    rows = d.select("doc_id", F.col("text").cast("binary").alias("__raw"))
    held = decontam._sieved(rows, longer.withColumn("text", F.col("text").cast("binary")), 10).where("__held").count()
    hit = decontam.annotate(d, longer).where("n_hit > 0").count()
    assert hit <= held <= hit + 1 < len(docs) / 2


def test_payload_of_most_pages_is_broadcast(spark):
    rows = [(k, "http://a/", None if k % 3 else "same" if k % 2 else f"own {k % 50}") for k in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    found = {r.page_id: r.refers_to for r in warc.decide(pages).collect()}
    by = {}
    for k, _, h in rows:
        by.setdefault(h or "", []).append(k)
    assert found == {k: max(ks) for ks in by.values() for k in ks if k != max(ks)}
