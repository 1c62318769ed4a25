"""Table functions from SQL."""

import datetime

import pytest

from lodestone.functions import table_functions


@pytest.fixture(scope="module")
def sql(spark):
    table_functions.register(spark)
    return lambda text: [tuple(r) for r in spark.sql(text).collect()]


def test_chunks(sql):
    assert sql("SELECT * FROM text_chunks('abcdefghij', 4, 1)") == [(0, "abcd"), (1, "defg"), (2, "ghij")]
    assert sql("SELECT * FROM text_chunks('abc', 4, 1)") == [(0, "abc")] and sql("SELECT * FROM text_chunks('', 4, 1)") == [] == sql("SELECT * FROM text_chunks(NULL, 4, 1)")
    assert len(sql("SELECT k, c.* FROM VALUES (1, 'abcdefgh'), (2, NULL), (3, 'ab') t(k, s), LATERAL text_chunks(s, 4, 0) c")) == 3


def test_links(sql):
    page = "<a href=\"/x?q=1\">One <b>b</b></a><a href=#f>no</a><a>none</a><a href=\"http://b.org/\">two</a><a href=\"mailto:a\">m</a>"
    assert sql(f"SELECT url, text FROM page_links('{page}', 'http://a.org/d/e')") == [("http://a.org/x?q=1", "One b"), ("http://b.org/", "two")]
    assert sql("SELECT * FROM page_links(NULL, 'x')") == []


def test_changes_requirements_and_spans(sql):
    assert sorted(sql("SELECT * FROM note_changes('Added async readers\nDeprecated old_api\nsyntax of lambdas\nbreaking change')")) == sorted([("feature", "async readers"), ("breaking", "breaking change"), ("deprecation", "old_api"), ("syntax", "of lambdas")])
    assert sql("SELECT * FROM requirement_lines('requests==2.31.0\n# c\n-r x.txt\nflask[async] >= 2.0 ; x\nnumpy\n')") == [("requests", "==", "2.31.0"), ("flask", ">=", "2.0"), ("numpy", None, None)]
    assert sql("SELECT * FROM code_spans('a = \"{\" // }', 'javascript')") == [(5, 6), (10, 12)] and sql("SELECT * FROM code_spans(NULL, 'rust')") == []


def test_sessions_are_partitioned_and_sorted_by_the_function(spark, sql):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [("a", at(m)) for m in (30, 0, 5, 33)] + [("b", at(1)), ("b", None), (None, at(2)), (None, at(3))]
    spark.createDataFrame(rows, "who string, ts timestamp").repartition(4).createOrReplaceTempView("clicks")
    got = sql("SELECT * FROM event_sessions(TABLE(SELECT who, ts FROM clicks), 600)")
    assert sorted(got, key=str) == sorted([("a", at(0), at(5), 2), ("a", at(30), at(33), 2), ("b", at(1), at(1), 1), (None, at(2), at(3), 2)], key=str)
    plan = spark.sql("SELECT * FROM event_sessions(TABLE(SELECT who, ts FROM clicks), 600)")._jdf.queryExecution().toString()
    assert "RepartitionByExpression" in plan or "hashpartitioning(who" in plan
    with pytest.raises(Exception, match="a table of a key and a time"):
        sql("SELECT * FROM event_sessions(1, 600)")
