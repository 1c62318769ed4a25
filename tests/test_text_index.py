"""The full-text index against scoring every document, and published sets of tables."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import publish, search, store, text_index
from lodestone.runtime import scratch_path


def _docs(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 60))]
        words += ["Hot"] * (k % 3 == 0) * rng.randrange(1, 9) + ["rare"] * (k % 97 == 0)
        rows.append((k * 7 % 100_003, " ".join(rng.sample(words, len(words)))))
    return spark.createDataFrame([*rows, (-5, None), (-6, ""), (-7, " \n\t ")], "doc_id long, text string").repartition(6)


@pytest.mark.parametrize("block", [1024, 16])
def test_same_documents_as_a_scan(spark, monkeypatch, block):
    monkeypatch.setattr(text_index, "BLOCK", block)
    monkeypatch.setattr(text_index, "FIRST_READ", 20)
    docs = _docs(spark, 2500, block)
    root = scratch_path(spark, "text-index")
    text_index.build(docs, root)
    for q in ("hot", "rare w1", "w1 w2 w3 hot", "w17 w400 hot", "absent", "absent rare", ""):
        want = [] if not q else [tuple(r) for r in search.bm25(docs, q, 10).collect()]
        found = text_index.search(spark, root, q)
        assert [tuple(r) for r in found.rows.orderBy(F.desc("score"), "id").collect()] == want, q
        assert found.blocks_read <= found.blocks_of_terms
    found = text_index.search(spark, root, "rare hot w1", 3)
    if block == 16:
        assert found.blocks_read < 0.7 * found.blocks_of_terms, (found.blocks_read, found.blocks_of_terms)


def test_common_term_is_cut_into_blocks_and_filters_reach_the_scan(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 50)
    root = scratch_path(spark, "text-index")
    text_index.build(_docs(spark, 1500, 3), root)
    blocks = publish.read(spark, root, "blocks")
    assert blocks.agg(F.max("n")).first()[0] <= 50 and blocks.where("term = 'hot'").count() >= 10
    assert blocks.where("low > high or size(ids) <> n").count() == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = blocks.where("term = 'hot' and layer = 3 and low <= 7")._jdf.queryExecution().toString()
    assert "EqualTo(term,hot)" in plan and "LessThanOrEqual(low,7)" in plan


def test_empty_index(spark):
    root = scratch_path(spark, "text-index")
    text_index.build(_docs(spark, 0, 1).limit(0), root)
    assert text_index.search(spark, root, "any word").rows.collect() == []
    with pytest.raises(FileNotFoundError):
        text_index.search(spark, scratch_path(spark, "nothing"), "word")


def test_readers_see_all_of_a_write_or_none(spark):
    root = scratch_path(spark, "sets")
    one, two = spark.range(3), spark.range(5)
    publish.publish(spark, root, {"a": one, "b": one})
    held = publish.published(spark, root)
    broken = two.select(F.raise_error(F.lit("lost")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, root, {"a": two, "b": broken})
    assert [publish.read(spark, root, t).count() for t in "ab"] == [3, 3]  # the half-written folder has no marker
    publish.publish(spark, root, {"a": two, "b": two})
    assert [publish.read(spark, root, t).count() for t in "ab"] == [5, 5]
    assert spark.read.parquet(f"{held}/a").count() == 3  # a reader that began before goes on
    publish.clean(spark, root)
    assert publish.read(spark, root, "b").count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{held}/a").count()


def test_write_both_is_one_write(spark):
    root = scratch_path(spark, "both")
    docs = spark.createDataFrame([(1, "a b", [1.0]), (2, "b", [2.0])], "doc_id long, text string, embedding array<double>")
    store.write_both(docs, root)
    store.write_both(docs.where("doc_id = 1"), root)
    assert publish.read(spark, root, "vectors").count() == 1
    assert {r.term for r in publish.read(spark, root, "terms").collect()} == {"a", "b"}


def test_blocks_are_sorted_once_and_whole(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 32)
    given, publish_ = {}, publish.publish
    monkeypatch.setattr(publish, "publish", lambda *a, sort, **k: given.update(sort) or publish_(*a, sort=sort, **k))
    root, docs = scratch_path(spark, "text-index"), _docs(spark, 3000, 11)
    text_index.build(docs, root)
    assert "blocks" not in given
    got = publish.read(spark, root, "blocks").select("term", F.explode(F.arrays_zip("ids", "counts", "lengths")).alias("p")).select("term", "p.*")
    words = docs.select("doc_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("ws"))
    want = words.select("doc_id", F.size("ws").alias("n"), F.explode("ws").alias("term")).groupBy("term", "doc_id", "n").count()
    assert sorted(map(tuple, got.collect())) == sorted((r.term, r.doc_id, r["count"], r.n) for r in want.collect())
