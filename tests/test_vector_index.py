"""Batched neighbours and the vector index against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, vector_index


def _frame(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)


def _exact(rows, k, every, apart=False):
    out = {}
    for q in range(0, len(rows), every):
        score = np.round(1 / (1 + np.sqrt(((rows - rows[q]) ** 2).sum(1))), 6)
        order = [int(i) for i in np.lexsort((np.arange(len(rows)), -score)) if not (apart and i == q)][:k]
        out[q] = [(i, float(score[i])) for i in order]
    return out


def _found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


def _queries(frame, every):
    return frame.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _clustered(n, d, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(40, d))[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, d))


@pytest.mark.parametrize("shift", [0.0, 80_000.0])
def test_batches_of_near_vectors_far_from_the_origin(spark, shift):
    rows = np.random.default_rng(2).normal(size=(1500, 64)) + shift
    frame = _frame(spark, rows)
    got = _found(search.knn_batch(frame, _queries(frame, 7), 5, exclude_self=True))
    assert got == _exact(rows, 5, 7, True)


def test_equal_scores_go_by_id_in_large_batches():
    rows = np.repeat(np.random.default_rng(1).normal(size=(50, 16)) * 1e-9 + 5, 30, axis=0)
    score = search.nearest_scores(rows[:600], rows, 10)
    assert (score > -np.inf).all()  # all are ties of six places


@pytest.mark.parametrize("rows", [_clustered(3000, 32, 1), _clustered(2000, 32, 4) + 50_000, np.random.default_rng(3).normal(size=(1500, 24)), np.zeros((300, 8))])
def test_search_without_probes_is_exact(spark, rows):
    frame = _frame(spark, rows)
    index = vector_index.build(frame)
    got = _found(vector_index.search(index, _queries(frame, 40), 10))
    assert got == _exact(rows, 10, 40)


def test_recall_at_two_scales_and_what_is_scanned(spark):
    for n in (1500, 6000):
        rows = _clustered(n, 32, n, 0.6)
        frame = _frame(spark, rows)
        index = vector_index.build(frame)
        queries = _queries(frame, n // 60)
        probes, reached = vector_index.calibrate(index, frame, queries, exclude_self=True)
        own = rows[:: n // 60]
        share = vector_index.scanned_share(index, own, 10, probes)
        assert reached >= 0.9 and share < 0.6, (n, probes, reached, share)
        assert vector_index.scanned_share(index, own, 10, len(index.counts)) == 1.0


def test_cells_prune_row_groups_and_codes_are_narrow(spark):
    rows = _clustered(2000, 32, 7)
    index = vector_index.build(_frame(spark, rows))
    plan = index.codes(spark).where(F.col("cell").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell, [1,2])]" in plan
    width = index.codes(spark).select(F.max(F.length("code"))).first()[0]
    assert width == 8 and index.codes(spark).count() == 2000 == index.counts.sum()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0]), (5, [5.0, 5.0]), (None, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'c' AS cell", "'x' AS code")
    index = vector_index.build(frame)
    queries = spark.createDataFrame([(9, [1.0, 2.0]), (10, None), (11, [1.0])], "query_id long, query array<double>")
    assert _found(vector_index.search(index, queries, 2)) == {9: [(1, 1.0), (2, 1.0)]}
    nothing = vector_index.build(frame.limit(0))
    assert vector_index.search(nothing, queries, 2).collect() == []
    portions = vector_index.search(index, spark.range(20).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("query")), 1, max_sent=3)
    assert len(portions.collect()) == 20


@pytest.mark.parametrize("probes", [None, 20])
def test_a_task_hands_on_a_bounded_number_of_rows(spark, probes):
    """Of vectors without clusters neither cells nor codes can leave out many."""
    rows = np.random.default_rng(6).normal(size=(4000, 24))
    frame = _frame(spark, rows)
    index = vector_index.build(frame)
    own = rows[::20]
    found = vector_index._exact(index, spark, np.arange(len(own)), own, 5) if probes is None else vector_index._coded(index, spark, np.arange(len(own)), own, probes, 5)[0]
    assert found.count() <= found.rdd.getNumPartitions() * len(own) * 5
    assert found.groupBy("query_id").count().where("count < 5").count() == 0
