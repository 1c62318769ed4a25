"""Every query of the subpackage on empty tables and on tables with nulls, ties, repeats and extra columns."""

import hashlib

import pytest

from lodestone.llm import queries

NAMES = sorted(queries.queries())
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, block long, tree string, fp long"
PAGES = "page_id long, url string, html string, path string, digest string"


TURNS = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, None, None, None), (2, 5, "", "x" * 100_000), (None, 1, "user", "no conversation"), (7, 1, "assistant", "中。"), (7, 2, "tool", "\x00")]


def _write(spark, folder, docs, pages, items, labels, turns=()):
    spark.createDataFrame([(*t, "p", 1) for t in turns], "conv_id long, turn long, role string, text string, place string, depth int").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, PAGES).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(items, "item_id long, text string, spans string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return _write(spark, str(tmp_path_factory.mktemp("empty")), [], [], [], [])


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    extra = (0.5, "k", 1, "t", 7)
    long = " ".join(f"word{k % 977}" for k in range(40_000))
    passage = " ".join(f"pass{k}" for k in range(30))
    texts = [None, "", " \n\t ", "one", "one", "Ünïcödé ß 中文 😀 one two three four", long, long + " end", passage + " a b c", "x y " + passage, "<|endoftext|> it's", "a\x00b \r\n c\x85d　e"]
    docs = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None if t is None else len(t), *extra) for k, t in enumerate(texts)]
    docs += [(3, "one", "en", "s", 3, *extra), (8, "another text under an old id", "fr", "s", 28, *extra)]
    pages = [(0, None, None), (1, "no url", ""), (2, "http://A.Example.ORG/es/x?q#f", "<p>a</p>"), (3, "http://A.Example.ORG/es/x?q#f", "<p>a</p>"), (4, "http://org", None), (5, "://", "ü"), (6, "https://example.org/en/12", "<p>a</p>"), (7, "https://x.com:80/fr/\n", "z" * 200_000)]
    items = [(0, None), (1, ""), (2, "..."), (3, passage), (3, passage), (4, "one")]
    labels = [(k, 1, None if k == 5 else k % 2, "t") for k in range(12)] + [(None, 1, 1, "t"), (99, 1, 1, "t"), (3, 0, 0, "t")]
    return _write(spark, str(tmp_path_factory.mktemp("odd")), docs, [(*p, "p", "d") for p in pages], [(*i, "s") for i in items], labels, TURNS)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(spark, odd, name):
    rows = queries.queries()[name](spark, odd).collect()
    if name.startswith(("op12_", "op13_")):
        if name.startswith("op12_"):
            assert {r.conv_id for r in rows} == {1, 2, 7, None} and len(rows) == 4
        else:
            root = next(r for r in rows if r.depth == 0)
            assert (root.conv_id, root.n_convs, root.parent_conv_id) == (1, 3, None) and {r.conv_id for r in rows} <= {1, 2, 7}
        return
    assert len(rows) == (8 if name.startswith(("op1_", "op4_")) else 14)
    if name.startswith("op6_"):
        empty = hashlib.sha256(b"").hexdigest()
        assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (0, 1)} == {(0, empty, empty)}
    if name.startswith("op7_"):
        assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    if name.startswith("op5_"):
        by = {r.doc_id: r for r in rows if r.n_items}
        assert by[9].n_hit == 30 and by[9].n_words == 32 and by[3].n_items == 1
    if name.startswith("op4_"):
        by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
        assert by[2] == ("a.example.org", "/es/x", "example.org/es/", "block") and by[0] == ("", "", None, "allow") == by[1]
        assert by[4] == ("org", "", None, "allow") and by[6][2:] == ("example.org/en/1", "block")
    if name.startswith("op1_"):
        by = {r.page_id: (r.record_type, r.refers_to) for r in rows}
        assert by[6] == ("response", None) and by[2] == ("revisit", 6) and by[0] == ("revisit", 4) and by[4] == ("response", None)


def test_pipeline_on_empty_tables(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []


def test_pipeline_on_odd_tables(spark, odd):
    """Copies, the contaminated and what is repeated go; the rest keeps its text, whatever it is."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, odd).collect()}
    assert set(rows) <= {r.doc_id for r in docs.collect()}
    # 1 and 2 are copies of the empty 0, 4 of 3; 3 and 5 hold the benchmark's one word; 7 is a near copy of 6, and 9 of 8, of whose
    # two texts one stays, which is contaminated or not
    assert set(rows) - {8} == {0, 6, 10, 11}
    assert rows[0].n_tokens == 0 and rows[6].n_tokens > 40_000
    assert rows[6].decoded_sha256 == hashlib.sha256(" ".join(f"word{k % 977}" for k in range(40_000)).encode()).hexdigest()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), odd).columns == list(corpus_pipeline.COLUMNS), name
