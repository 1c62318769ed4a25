"""Functions and operators on inline rows with values worked out by hand."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.functions import chunk, classify, code, html, quality, text, url, vectors, versions
from lodestone.operators import crawl, packages, policies, profile, search, similarity, store
from lodestone.sources import feeds, manifests


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


PAIRS = [
    ("This is a test document about Rust programming.", "This is a test document about Rust programming.", 1.0, 1.0),
    ("This is a test document about Rust programming language.", "This is a test document about Rust programming and development.", 0.8, 0.909333),
    ("This is about Rust programming.", "This is about Python web development.", 0.0, 0.416937),
    ("rust programming language tutorial", "rust programming language guide", 0.75, 0.894706),
]


@pytest.mark.parametrize(("a", "b", "words", "whole"), PAIRS)
def test_similarity(spark, a, b, words, whole):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    r = rows.select(text.text_similarity(F.col("a"), F.col("b")), text.document_similarity(F.col("a"), F.col("b")), text.document_similarity(F.col("b"), F.col("a"))).first()
    assert r[0] == pytest.approx(words, abs=1e-5)
    assert r[1] == pytest.approx(whole, abs=1e-5) and r[1] == pytest.approx(r[2])
    f = similarity.features(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string"))
    both = f.where("doc_id = 0").select(F.col("f").alias("a")).crossJoin(f.where("doc_id = 1").select(F.col("f").alias("b")))
    assert both.select(similarity.compare(F.col("a"), F.col("b"))).first()[0] == pytest.approx(whole, abs=1e-5)


def test_empty_texts_are_alike(spark):
    rows = spark.createDataFrame([("", ""), ("test", "")], "a string, b string")
    assert [r[0] for r in rows.select(text.text_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]


def test_near_duplicates_find_copies(spark):
    rng = random.Random(0)
    rows = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(80))) for k in range(30)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + " tail"), (102, "")]
    found = {(r.left_id, r.right_id) for r in similarity.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {(3, 100), (3, 101)}


def test_near_duplicates_are_all_pairs_behind_unlike_hubs(spark):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    bases = [prose(90) for _ in range(4)]
    words = {}
    for k in range(240):  # smaller ids, a third of a base each: they are the smallest of the bands
        at = rng.randrange(60)
        words[k] = [*prose(40), *bases[k % 4][at : at + 30], *prose(20)]
    for k in range(1000, 1032):
        words[k] = bases[k % 4][:]
        for _ in range(rng.randrange(5)):
            words[k][rng.randrange(90)] = f"edit{k}"
    docs = [(k, " ".join(w)) for k, w in words.items()] + [(2000 + k, " ".join(words[1000 + k])) for k in range(6)]
    docs += [(3000, "Sol"), (3001, "sol"), (3002, "other"), (3003, None), (3004, "")]
    got = similarity.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    pairs = spark.createDataFrame(docs[240:], "doc_id long, text string")
    f = similarity.features(pairs.where("length(text) > 0"))
    both = f.alias("a").crossJoin(f.alias("b")).where("a.doc_id < b.doc_id")
    like = both.select(F.col("a.doc_id"), F.col("b.doc_id"), F.round(similarity.compare(F.col("a.f"), F.col("b.f")), 6).alias("s")).where("s >= 0.85").collect()
    text_of, first = dict(docs), {}
    for k, t in docs:
        first.setdefault(t, k)
    want = {(a, b, s) for a, b, s in like if (first[text_of[a]] == a and first[text_of[b]] == b) or (text_of[a] == text_of[b] and first[text_of[b]] == a)}
    assert len(want) > 80 and (3000, 3001) in {w[:2] for w in want}
    assert {(r.left_id, r.right_id, r.similarity) for r in got} == want
    assert all(r.same_text == (text_of[r.left_id] == text_of[r.right_id]) for r in got) and len(got) == len(want)


def test_normalize_and_keywords(spark):
    r = one(spark, text.normalize(F.lit("  This   is\n\na  messy\n\n\ntext   with   extra   spaces  \n\n")), F.array_sort(text.keywords(F.lit("This async function calls an HTTP method of the framework."))))
    assert r[0] == "This is a messy text with extra spaces"
    assert r[1] == ["async", "framework", "function", "http", "method", "this"]


def test_ngrams(spark):
    words = F.array(*[F.lit(w) for w in "a b cc dd".split()])
    r = one(spark, text.ngrams(words, 2), text.ngrams(words, 3), text.ngrams(words, 5), text.ngrams(F.array().cast("array<string>"), 2))
    assert list(r) == [["b cc", "cc dd"], ["a b cc", "b cc dd"], [], []]


def test_hybrid_score(spark):
    score = search.hybrid_score(F.lit(1 / 1.5), "rust vec api", title=F.lit("Vec API"), content=F.lit("A growable array. Vec is here"), language=F.lit("rust"), package=F.lit("std"), doc_type=F.lit("api_doc"))
    assert one(spark, F.round(score, 6))[0] == pytest.approx(0.71)


def test_vectors(spark):
    embed4, embed3 = vectors.mock_embedding(4), vectors.mock_embedding(3)
    r = one(spark, embed4(F.lit("hello")), embed3(F.lit("")))
    assert r[0] == pytest.approx([0.497679, 0.499224, 0.50077, 0.502315], abs=1e-5)
    assert r[1] == pytest.approx([0, 0.447214, 0.894427], abs=1e-5)
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0))
    r = one(spark, vectors.cosine(a, b), vectors.l2_distance(a, b), vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0))))
    assert list(r) == [0.0, None, 0.0]


def test_batched_neighbours_are_the_exact_ones(spark):
    rng = random.Random(1)
    rows = [(k, [rng.random() for _ in range(8)]) for k in range(200)] + [(500, None), (501, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for metric in ("l2", "cosine"):
        got = search.knn_batch(df, queries, 4, metric=metric).orderBy("query_id", "rank").collect()
        for q in range(5):
            want = [(r.vec_id, r.score) for r in search.knn(df.where("size(embedding) = 8"), rows[q][1], 4, metric=metric).collect()]
            assert [r.id for r in got if r.query_id == q] == [w[0] for w in want]


def test_batched_neighbours_in_portions(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(k, [rng.random() for _ in range(4)]) for k in range(60)], "vec_id long, embedding array<float>")
    queries = df.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = sorted(map(tuple, search.knn_batch(df, queries, 3).collect()))
    got = search.knn_batch(df, queries, 3, config=Config(max_sent_vectors=10))  # four portions, even and on the bound
    assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError, match="query_id"):
        search.knn_batch(df, queries.withColumn("query_id", F.lit(1)), 3, config=Config(max_sent_vectors=20))


def test_chunks_cover_the_text(spark):
    body = "\n\n".join("p" * (50 + 37 * (k % 9)) for k in range(60))
    r = one(spark, chunk.fixed_chunks(F.lit(body)), chunk.paragraph_chunks(F.lit(body)), chunk.fixed_chunks(F.lit("")), chunk.paragraph_chunks(F.lit("short")))
    assert r[0][0] + "".join(c[100:] for c in r[0][1:]) == body
    assert all(b.startswith(a[-100:]) for a, b in zip(r[1], r[1][1:], strict=False)) and len(r[1]) > 1
    assert r[2] == [] and r[3] == ["short"]


def test_readability(spark):
    t = F.lit("The quick brown fox jumps over the lazy dog. However, the dog was not amused.")
    r = one(spark, F.size(text.tokens(t)), F.size(quality.sentences(t)), quality.syllables(t), F.round(quality.readability(t), 6))
    assert list(r) == [15, 2, 21, 0.807825]


def test_versions(spark):
    rows = spark.createDataFrame([("1.10.0",), ("1.9.0",), ("v2.0-rc1",), ("1.9",)], "v string")
    assert [r.v for r in rows.orderBy(versions.sort_key(F.col("v")), "v").collect()] == ["1.9", "1.9.0", "1.10.0", "v2.0-rc1"]
    body = F.lit("Added async support: faster\nDeprecated old_api\nBreaking change in parser\nversion 1.2.3")
    r = one(spark, versions.mined_versions(body), versions.mined(body, versions.FEATURE_PATTERNS), versions.mined(body, versions.BREAKING_PATTERNS), versions.feature_name(F.lit("async support: faster (x)")), versions.feature_category(F.lit("new trait"), F.lit("rust")))
    assert r[0] == ["1.2.3"] and "async support: faster" in r[1] and "Breaking change" in r[2] and r[3] == "async support" and r[4] == "TypeSystem"
    assert list(one(spark, versions.from_output(F.lit("rustc 1.75.0 (abc)")), versions.from_output(F.lit("go version go1.21")))) == ["1.75.0", "go1.21"]


def test_severities(spark):
    labels = ["moderate", "IMPORTANT", "severe", "minor", "CVSS:3.1/AV:N"]
    rows = spark.createDataFrame([(x,) for x in labels], "s string")
    assert [r[0] for r in rows.select(versions.severity(F.col("s"))).collect()] == ["MEDIUM", "HIGH", "CRITICAL", "LOW", "UNKNOWN"]


def test_code(spark):
    c = F.lit("fn main() {\n    if a { x } else { y }\n    for i in 0..3 { }\n}")
    assert list(one(spark, code.complexity(c, F.lit("rust")), code.line_count(c), F.length(c))) == [7, 4, 61]
    files = [("a.rs", "/// doc\nfn a() {}\n\nfn b() {}"), ("b.py", 'def f():\n    """doc"""\n\ndef g():\n    pass'), ("c.txt", "none")]
    rows = {r.path: (r.functions, r.documented, r.coverage) for r in profile.code_coverage(spark.createDataFrame(files, "path string, code string")).collect()}
    assert rows == {"a.rs": (2, 1, 50.0), "b.py": (2, 1, 50.0), "c.txt": (0, 0, 100.0)}


def test_html(spark):
    page = """<html><head><title> T &amp; U </title></head><body><main>Intro text that is long enough to be the main content of the page, with more than one hundred bytes in it, surely.
    <pre><code class="language-rust">fn main() { }</code></pre><code>let x = 12345;</code><div class="method"><h3>run</h3>Runs the thing with every option that it has, and then some more.</div>
    <a href="rel">r</a><a href="/root">o</a><a href="https://x.org/a">x</a><a href="#f">f</a><img src="i.png" alt="I"><b>open</main></body></html>"""
    e = html.extract(spark.createDataFrame([("https://e.org/d/p.html", page), (None, None)], "url string, html string")).orderBy(F.desc_nulls_last("url")).collect()
    x = e[0].extracted
    assert x.title == "T & U" and x.main.startswith("Intro text")
    assert [(c.language, c.code) for c in x.code] == [("rust", "fn main() { }"), (None, "let x = 12345;")]
    assert x.apis[0].title == "run" and [a.url for a in x.links] == ["https://e.org/d/rel", "https://e.org/root", "https://x.org/a"] and x.images[0].alt == "I"
    assert e[1].extracted.links == [] and e[1].extracted.title is None
    r = one(spark, html.clean(F.lit("<p>a &lt;b&gt; &amp;  long enough</p><script>x</script>")), html.clean(F.lit("<p>a</p>"), "none"), html.drop_noise(F.lit("one two three four\nshort\nCopyright by us all here")))
    assert list(r) == ["a <b> & long enough", "none", "one two three four"]


def test_lines_are_trimmed_of_spaces_only(spark):
    lines = ["  ends with a 0 0 ", "the second ends with 1", " in all it is 22"]
    r = one(spark, html.drop_noise(F.lit("\n".join(lines))), versions.mined(F.lit("syntax one here 100\nsyntax two here 211 "), versions.SYNTAX_PATTERNS[:1]))
    assert r[0] == "ends with a 0 0\nthe second ends with 1\nin all it is 22"
    assert r[1] == ["one here 100", "two here 211"]


def test_references_end_with_a_semicolon(spark):
    page = "<title>a&amp;&amp</title><body><main>x &copy 1 &copy; &#38 &notit; &#65; &bogus;</main><a href='/q?a=1&copy=2&amp;b=3'>to</a><script>a && b</script>"
    e = html.extract(spark.createDataFrame([("https://e.org/", page)], "url string, html string")).first()["extracted"]
    assert e["title"] == "a&&amp"
    assert "x &copy 1 \u00a9 &#38 &notit; A &bogus;" in e["main"]
    assert [x["url"] for x in e["links"]] == ["https://e.org/q?a=1&copy=2&b=3"]


def test_a_fragment_without_content_has_no_text(spark, tmp_path):
    from lodestone.plans import knowledge

    rows = [(1, None, "en", "src1"), (2, "", "en", "src1"), (3, " \n", "en", "src1"), (4, "text", "en", "src1"), (11, "text", "en", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["title"]: r["has_text"] for r in knowledge.fragment_records(spark, str(tmp_path)).collect()} == {"doc1": False, "doc2": False, "doc3": False, "doc4": True, "doc11": False}


def test_main_content_must_be_longer_than_the_fallback(spark, tmp_path):
    from lodestone.plans import libraries

    rows = [(n, "u", f"<article>{'m' * n}</article>") for n in (118, 119, 120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r["page_id"]: r["chosen"] for r in libraries.regex_main_content(spark, str(tmp_path)).collect()} == {118: "fallback", 119: "fallback", 120: "main"}


def test_urls(spark):
    u = F.lit("https://docs.rs/serde/1.0.2/serde/index.html?x#y")
    h, p = url.host(u), url.path(u)
    r = one(spark, h, p, url.depth(p), url.extension(p), url.has_version(p), url.authority(h), url.is_official(h), url.version(u), url.language_match(u, "rust"), F.explode(url.candidates(F.lit("https://e.org"), F.array(F.lit("1.2")))))
    assert list(r)[:9] == ["docs.rs", "/serde/1.0.2/serde/index.html", 4, "html", True, 0.9, True, "1.0.2", 0.6]
    d = one(spark, url.discovery(F.lit("https://github.com/rust-lang/rust/releases"), "rust"))[0]
    assert (d.url_type, round(d.confidence, 6), d.priority) == ("GitHubRelease", 1.0, 1)


def test_classification(spark):
    r = one(spark, classify.page_type(F.lit("See the CHANGELOG")), classify.region_type(F.lit("fn main() {}")), classify.region_type(F.lit("Home")), classify.code_language(F.lit("def f():\n  return 1")), classify.code_language(F.lit("none")))
    assert list(r) == ["Changelog", "code", "navigation", "python", None]


def test_manifests(spark):
    files = [
        ("p/package.json", '{"dependencies": {"lodash": "^4.17.20", "express": "^4.18.0"}, "devDependencies": {"jest": "^29.0.0"}}'),
        ("bad/package.json", "{"),
        ("r/Cargo.toml", '[dependencies]\nserde = "1.0"\ntokio = { version = "1.0" }\n[dev-dependencies]\nx = { path = "." }'),
        ("bad/Cargo.toml", "[["),
        ("y/requirements.txt", "requests==2.31.0\nflask>=2.0\nnumpy\n# c\n-r x.txt\n"),
        ("g/go.mod", "module m\nrequire a.b/c v1.2.3\nrequire (\n\td.e/f v0.1.0 // indirect\n\tg.h/i v2.0.0\n)\n"),
        ("m/pom.xml", "<project><dependencies><dependency><groupId>a</groupId><artifactId>b</artifactId><version>1</version></dependency><dependency><groupId>c</groupId><artifactId>d</artifactId><scope>test</scope></dependency></dependencies></project>"),
        ("d/pubspec.yaml", "name: x\ndependencies:\n  http: ^1.1.0\n  flutter:\n    sdk: flutter\ndev_dependencies:\n  test: 1.24.0\n"),
        ("q/pyproject.toml", '[project]\ndependencies = ["pandas>=2.0", "rich"]'),
        ("n/package.json", None),
    ]
    rows = manifests.dependencies(spark.createDataFrame(files, "path string, content string")).collect()
    got = {(r.name, r.version, r.kind) for r in rows if not r.error}
    assert got == {
        ("lodash", "4.17.20", "direct"), ("express", "4.18.0", "direct"), ("jest", "29.0.0", "dev"), ("serde", "1.0", "direct"), ("tokio", "1.0", "direct"), ("x", "*", "dev"),
        ("requests", "2.31.0", "direct"), ("flask", "2.0", "direct"), ("numpy", "*", "direct"), ("a.b/c", "1.2.3", "direct"), ("d.e/f", "0.1.0", "direct"), ("g.h/i", "2.0.0", "direct"),
        ("a:b", "1", "compile"), ("c:d", "*", "test"), ("http", "1.1.0", "direct"), ("test", "1.24.0", "dev"), ("pandas", "2.0", "direct"), ("rich", "*", "direct"),
    }
    assert {r.path for r in rows if r.error} >= {"bad/package.json", "bad/Cargo.toml"}


def test_feeds(spark):
    osv = '{"id": "G-1", "aliases": ["X", "CVE-1"], "database_specific": {"severity": "MODERATE"}, "references": [{"url": "u"}], "affected": [{"package": {"name": "p"}, "versions": ["1", "2"], "ranges": [{"events": [{"introduced": "0"}, {"fixed": "3"}]}]}]}'
    r = feeds.osv(spark.createDataFrame([(osv,), ("no json",)], "reply string")).collect()
    assert [(x.id, x.cve, x.package, x.severity, x.affected_versions, x.fixed_versions, x.references) for x in r] == [("G-1", "CVE-1", "p", "MEDIUM", ["1", "2"], ["3"], ["u"])]
    rel = '[{"tag_name": "v1.2", "body": "b", "published_at": "2024-01-02T03:04:05Z", "prerelease": false}, {"tag_name": "v2", "draft": true}]'
    r = feeds.releases(spark.createDataFrame([("rust", rel)], "language string, reply string")).collect()
    assert [(x.version, x.is_stable, x.release_date) for x in r] == [("1.2", True, datetime.datetime(2024, 1, 2, 3, 4, 5))]
    assert [(x.kind, x.value) for x in feeds.robots(spark.createDataFrame([("User-agent: *\nSitemap: https://e.org/s.xml\nDisallow: /x # c",)], "reply string")).collect()] == [("sitemap", "https://e.org/s.xml"), ("disallow", "/x")]
    assert [x.version for x in feeds.rss_titles(spark.createDataFrame([("<title>Feed</title><item><title>App v1.2.3</title></item>",)], "reply string")).collect()] == ["1.2.3"]
    assert one(spark, feeds.latest_version(F.lit("npm"), F.lit('{"dist-tags": {"latest": "9"}}')), feeds.address(F.lit("pypi"), F.lit("x")))[0] == "9"


def test_releases(spark):
    schema = "language string, version string, release_date string, features array<struct<name:string,description:string,category:string,impact:string,tags:array<string>>>, breaking_changes array<struct<description:string>>"
    rows = spark.createDataFrame([("rust", "1.1", "2024-02", [("async", "d", "Async", "High", ["x"])], []), ("rust", "1.0", "2024-01", [("macro", "d", "Macros", "Low", ["async-tag"])], [("b",)])], schema)
    assert [(r.version, r.features, r.breaking, r.high_impact) for r in packages.timeline(rows).collect()] == [("1.1", 1, 0, ["async"]), ("1.0", 1, 1, [])]
    assert {r.name for r in packages.search_features(rows, "ASYNC").collect()} == {"async", "macro"}
    assert {r.name for r in packages.search_features(rows, "async", "Async").collect()} == {"async"}


@pytest.mark.parametrize(
    ("source", "value"),
    [('score >= 0.5 && has_file("Cargo")', True), ('language == "rust" || files_count > 2', True), ('(has_cli("cargo"))', True), ("true", True), ('(score < 0.5 && true) || has_framework("axum")', True),
     ('has_cli("npm")', False), ("score >=", False), ("no such thing", False), ('language != "rust"', False)],
)
def test_predicates(spark, source, value):
    rows = spark.createDataFrame([("rust", 0.7, ["Cargo.toml"], [("cargo", True), ("npm", False)], ["axum-web"])], "language string, score double, project_files array<string>, cli_tools array<struct<name:string,available:boolean>>, detected_features array<string>")
    assert rows.select(policies.predicate(source)).first()[0] is value
    assert rows.where(policies.condition("required_cli_tools", ["cargo"])).count() == 1 == policies.plan(rows, "intelligent").count()
    assert rows.where(policies.parsed_condition({"op": "not", "items": [{"field": "language", "compare": "matches", "value": "^py"}]})).count() == 1


def test_profile(spark):
    files = [(p,) for p in ("Cargo.toml", "src/a.rs", "src/b.RS", "x.py", "node_modules/y.js", "odd.zzz", ".hidden", "docs/readme.md")]
    rows = {r.language: (r.files, r.weight, round(r.share, 4)) for r in profile.languages(spark.createDataFrame(files, "path string")).collect()}
    assert rows == {"rust": (2, 12, 0.9231), "python": (1, 1, 0.0769)}
    assert list(one(spark, profile.file_stem(F.lit("a/b.c.md")), profile.folder(F.lit("a/b.md")), profile.file_type(F.lit("x/test_a.py")), profile.file_type(F.lit("a/README.md")))) == ["b.c", "a", "test", "documentation"]


def test_crawl(spark):
    links = [("a", "b", 5, 1.0), ("a", "c", 9, 1.0), ("b", "a", 1, 1.0), ("c", "d", 1, 1.0), ("c", "low", 9, 0.1), ("d", "e", 1, 1.0), ("e", "f", 1, 1.0)]
    df, seeds = spark.createDataFrame(links, "page string, link string, priority int, relevance double"), spark.createDataFrame([("a", 1)], "page string, priority int")
    got = {r.page: r.depth for r in crawl.crawl(df, seeds, max_depth=3, min_relevance=0.5).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {r.page for r in crawl.crawl(df, seeds, max_pages=2, min_relevance=0.5).collect()} == {"a", "c"}
    at = datetime.datetime(2024, 1, 1)
    visits = [("x", at + datetime.timedelta(hours=k)) for k in range(4)] + [("y", at + datetime.timedelta(minutes=k)) for k in range(3)] + [("z", at + datetime.timedelta(hours=k)) for k in range(3)]
    assert {r.page for r in crawl.loops(spark.createDataFrame(visits, "page string, ts timestamp")).collect()} == {"x", "y"}


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "2020"), (2, "b", "2020")], "doc_id long, text string, created_at string")
    new = spark.createDataFrame([(2, "B", "2024"), (3, "c", "2024"), (3, "d", "2024")], "doc_id long, text string, created_at string")
    assert {tuple(r) for r in store.insert_absent(docs, new, ["text"]).collect()} == {(1, "a", "2020"), (2, "b", "2020"), (3, "c", "2024")}
    assert {tuple(r) for r in store.replace(docs, new.where("doc_id = 2")).collect()} == {(1, "a", "2020"), (2, "B", "2020")}
    store.snapshot(docs.drop("created_at"), str(tmp_path / "s/a"))
    store.snapshot(new, str(tmp_path / "s/b"))
    assert store.load(spark, str(tmp_path / "s/*")).columns == ["doc_id", "text", "created_at"]


def test_configuration_and_parameters(tmp_path):
    from lodestone import config

    assert config.load((str(tmp_path / "none.toml"),)) == config.DEFAULT
    path = tmp_path / "own.toml"
    path.write_text("chunk_size = 50\nhybrid_weights = [0.5, 0.5]\n")
    got = config.load((str(tmp_path / "none.toml"), str(path)))
    assert got.chunk_size == 50 and got.hybrid_weights == (0.5, 0.5) and got.chunk_overlap == config.DEFAULT.chunk_overlap
    path.write_text("chunk = 1\n")
    with pytest.raises(ValueError):
        config.load((str(path),))
    rules = {"query": {"type": str, "required": True, "least": 1}, "limit": {"type": int, "least": 1, "most": 100}, "language": {"one_of": ("rust", "go")}}
    assert config.validate({"query": "a", "limit": 5, "language": "go"}, rules) == []
    assert config.validate({"limit": 500, "language": "c", "more": 1}, rules) == ["query is missing", "limit is out of range", "language is none of ['rust', 'go']", "more is unknown"]
    assert config.validate({"query": "", "limit": True}, rules) == ["query is out of range", "limit is no int"]


def test_crawl_stops():
    assert crawl.finished(100, 5, 0) == "page budget" and crawl.finished(3, 0, 0) == "nothing left"
    assert crawl.finished(3, 5, 20) == "enough relevant pages" and crawl.finished(3, 5, 1) is None


def test_structure_of_unreadable_and_hostile_code(spark):
    from lodestone.functions import apidoc

    rows = [("a", "def f(:", "python"), ("b", "fn f() {" * 3000, "rust"), ("c", None, "python"), ("d", "function g(a) { if (a) { for(;;){} } while(a) {} }", "typescript"), ("e", "fn f() {}", "go")]
    got = {r.path: (r.name, r.complexity) for r in apidoc.structure(spark.createDataFrame(rows[:1] + rows[2:], "path string, code string, language string")).collect()}
    assert got == {"d": ("g", 3)}
    assert apidoc.structure(spark.createDataFrame([("b", "fn f() {" * 300, "rust")], "path string, code string, language string")).count() == 300


def test_html_of_any_depth_and_length(spark):
    from lodestone.functions import html

    deep, long = "<div>" * 30_000 + "end", "<p>word</p>" * 50_000
    rows = html.extract(spark.createDataFrame([("u", deep), ("u", long), ("u", "<a href='http://[x'>t</a><<<>&#xffffffff;")], "url string, html string")).select(F.length("extracted.main").alias("n")).collect()
    assert sorted(r.n for r in rows)[-1] == 5 * 50_000 - 1
