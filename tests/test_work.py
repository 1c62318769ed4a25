"""Work is done once, and only for the rows that need it."""

from pyspark.sql import functions as F

from lodestone.operators import similarity
from lodestone.plans import code, web


def test_only_unequal_texts_of_one_version_are_compared(spark, monkeypatch):
    schema = "id string, version string, content string"
    old = spark.createDataFrame([("a", "1", "same text"), ("b", "1", "another"), ("e", "1", None)], schema)
    new = spark.createDataFrame([("a", "1", "same text"), ("b", "2", "text"), ("c", "1", "text"), ("d", "1", None), ("e", "1", "text")], schema)
    want = {"a": True, "b": False, "c": False, "d": False, "e": False}
    decide = lambda: {r.id: r.duplicate for r in similarity.duplicate_decision(old, new, ["id"]).collect()}
    assert decide() == want
    given = lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.raise_error(F.lit("compared")).cast("double")).otherwise(0.0)
    monkeypatch.setattr(similarity, "document_similarity", given)
    assert decide() == want


def test_blocks_of_a_page_are_cut_once(spark, data):
    plan = web.dense_main_content(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_files_made_of_short_rows_are_dealt_to_all_tasks(spark, data):
    assert code._files(spark, data).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert code.api_definitions(spark, data).count() == spark.read.parquet(f"{data}/part.parquet").selectExpr("sum(if(p_partkey % 4 < 3, 3, 1))").first()[0]
