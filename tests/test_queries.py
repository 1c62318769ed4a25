"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from lodestone.plans import catalog

BY_RECALL = {"vector_index_probes"}  # approximate; its recall is tested in test_vector_index.py
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return "~"
        if isinstance(v, (bool, str)):
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.6f}" if not isinstance(v, pd.Timestamp) and not str(getattr(v, "dtype", "")).startswith(("datetime", "bool")) else str(v)
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, sql, name):
    if name not in catalog.ORACLES:
        assert name in BY_RECALL, "a query without SQL"
        assert catalog.QUERIES[name](spark, data).count() > 0
        return
    got = catalog.QUERIES[name](spark, data).toPandas()
    want = sql.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_entry_runs_without_the_subpackage(spark, monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "llm_queries", None)
    names = set(__spark_entry__.queries())
    assert names == set(catalog.QUERIES) and set(__spark_entry__.oracle_sql()) <= names
    assert __spark_entry__.entry(spark).count() > 0
