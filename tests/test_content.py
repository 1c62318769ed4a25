"""Text density, natural languages and code structure on hand-made and random texts."""

import itertools
import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from lodestone.functions import apidoc, density, insight, lexer, quality
from lodestone.operators import languages

RUST = '''// } not a brace
fn first(x: &'static str) -> usize {
    let s = "{ if \\" {"; /* while { /* nested } */ } */
    let c = '{';
    if x.len() > 1 { println!("}}"); }
    for _ in 0..2 { if true {} }
    let raw = r#"fn fake() { "quoted" "#;
    s.len()
}

mod inner {
    fn second() { loop { break; } }
}
'''
SCRIPT = '''function outer(a) {
  const t = `if { ${a ? `${"}"} while` : {b: "}"}} }`; // for {
  if (a) { return '}'; }
  function nested(b) {
    while (b) { b--; }
    for (;;) { break; }
  }
  /* catch } */
}
'''


def test_braces_in_strings_and_comments_are_no_code(spark):
    files = spark.createDataFrame([(1, RUST, "rust"), (2, SCRIPT, "javascript"), (3, SCRIPT, "typescript"), (4, "fn open() { if x { ", "rust"), (5, 'fn s() { let x = "unended {', "rust"), (6, None, "rust")], "path int, code string, language string")
    got = sorted(tuple(r) for r in apidoc.structure(files).collect())
    own = [("outer", 1, 9, 2), ("nested", 4, 7, 3)]
    want = [(1, "first", 2, 9, 3), (1, "second", 12, 12, 2), *[(k, *x) for k in (2, 3) for x in own], (4, "open", 1, 1, 2), (5, "s", 1, 1, 1)]
    assert got == sorted(want)


def test_blanks_keep_places():
    for language, code in itertools.product(lexer.OPENINGS, (RUST, SCRIPT, "", "'", '"', "/*", "`${", "a\n'b\n# c")):
        plain = lexer.blanked(code, language)
        assert len(plain) == len(code) and [i for i, c in enumerate(plain) if c == "\n"] == [i for i, c in enumerate(code) if c == "\n"]
        assert all(a in (b, " ") for a, b in zip(plain, code, strict=True))
    assert lexer.blanked('x = "a#b" # c', "python") == 'x = "   " #  '
    long = '"' + "{" * 300_000 + '" }'
    assert lexer.blanked(long, "java").count("}") == 1


def test_best_run_is_the_best_of_all_runs(spark):
    rng = random.Random(5)
    rows = [[rng.randrange(-30, 30) for _ in range(rng.randrange(0, 14))] for _ in range(300)]
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, w array<int>")
    for r in frame.select("k", "w", density.best_run(F.col("w")).alias("run")).collect():
        sums = {(a, b): sum(r.w[a : b + 1]) for a in range(len(r.w)) for b in range(a, len(r.w))}
        best = max(sums.values(), default=0)
        if best <= 0:
            assert r.run is None
        else:
            assert tuple(r.run) == (*min((x for x, s in sums.items() if s == best), key=lambda x: (x[1], -x[0])), best)


def test_menus_and_footers_are_left_out(spark):
    text = "A sentence of the article that is long enough to be worth more than it costs. "
    page = f"<html><head><title>{text * 9}</title></head><body><nav><ul>{'<li><a href=x>Some link of the menu</a></li>' * 9}</ul></nav><div><h1>Head</h1><p>{text * 3}</p><script>{text * 50}</script><p>short</p><p>{text * 2}</p></div><footer><a href=y>{text}</a> (c)</footer>"
    frame = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>tiny</p>")], "k int, html string")
    got = {r.k: r.m for r in frame.select("k", density.main_content(F.col("html")).alias("m")).collect()}
    assert got[1].text == f"{(text * 3).strip()}\nshort\n{(text * 2).strip()}" and got[2] is got[3] is got[4] is None


def test_eight_languages(spark):
    texts = {
        "en": "There was nobody in the street when we came out of the house in the morning.", "de": "Es war niemand auf der Straße, als wir am Morgen aus dem Haus kamen.",
        "fr": "Il n'y avait personne dans la rue quand nous sommes sortis de la maison le matin.", "es": "No había nadie en la calle cuando salimos de la casa por la mañana.",
        "zh": "早上我们走出房子的时候，街上没有人。", "ja": "朝、家を出たとき、通りには誰もいませんでした。", "ko": "아침에 집을 나섰을 때 거리에는 아무도 없었다.", "ru": "Когда утром мы вышли из дома, на улице никого не было.",
    }
    rows = [*texts.items(), ("none1", None), ("none2", ""), ("none3", "123 !?"), ("none4", "Καλημέρα κόσμε")]
    frame = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: r.language for r in languages.detect(frame, id_column="id").collect()}
    assert got == {**{k: k for k in texts}, **{f"none{k}": None for k in range(1, 5)}}


@pytest.mark.parametrize(("fitted", "least"), [(False, 0.9), (True, 0.97)])
def test_accuracy_on_documents(spark, fitted, least):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and n_chars > 40")
    profiles = languages.profiles_of(docs.where("doc_id % 2 = 0")) if fitted else None
    tried = docs.where("doc_id % 2 = 1")
    found = languages.detect(tried, profiles=profiles).join(tried.select("doc_id", "lang"), "doc_id")
    right = found.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert right >= least


def _coherence(text):
    """By the definition, a sentence and a word at a time."""
    parts = [p for p in re.split("[.!?]", text) if p.strip(" \t\n\x0b\f\r")]
    sets = [{w for w in (regex.sub(r"^[^\p{L}]+|[^\p{L}]+$", "", w.lower()) for w in re.split(r"[ \t\n\x0b\f\r]+", p)) if len(w.encode()) > 2} for p in parts]
    likes = [len(a & b) / len(a | b) for a, b in itertools.pairwise(sets) if a and b]
    if len(parts) < 2:
        return 0.5
    return (sum(likes) / len(likes) if likes else 0.0) + min(sum(text.lower().count(t) for t in quality.TRANSITIONS) / len(parts), 0.3)


def _syllables(text):
    words = [regex.sub(r"[^\p{L}]", "", w) for w in text.lower().split()]
    groups = [(w, max(len(re.findall("[aeiouy]+", w)), 1)) for w in words if w]
    return sum(n - (w.endswith("e") and n > 1) for w, n in groups)


def test_coherence_and_syllables_of_odd_texts(spark):
    rng, signs = random.Random(8), ["the", "Tree", "ee", "e", "-x-", "in contrastherefore", "However,", ".", "!", "?", "\n", "%%%", "a-b", "Käse", "bcd", "die", "ye", "12e"]
    texts = ["", " ", ".", "one. ", "a.b", *(" ".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(150))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select("k", quality.coherence(F.col("t")), quality.syllables(F.col("t"))).collect()
    for k, c, n in rows:
        assert c == pytest.approx(_coherence(texts[k])), texts[k]
        assert n == _syllables(texts[k]), texts[k]


@pytest.mark.parametrize(("measure", "part"), [(quality.coherence, "split("), (quality.coherence, "lower("), (lambda t: insight.semantics(t)["technologies"], "lower("), (quality.technical_score, "lower(")])
def test_a_text_is_cut_and_lowered_once(spark, measure, part):
    plan = spark.createDataFrame([("a",)], "t string").repartition(2).select(measure(F.col("t")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(part) == 1
    assert "lambda" not in plan or not re.search(r"lambdafunction\(Contains\(lower", plan)


def test_semantics_are_computed_once_for_all_their_parts(spark, data):
    from lodestone.plans import knowledge

    plan = knowledge.text_semantics(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(") == 1 and plan.count("lower(") == 3


@pytest.mark.parametrize("name", ["similarity_parts", "pairwise_text_similarity", "document_similarity"])
def test_pairs_of_texts_are_compared_by_measures(spark, data, name):
    """Neither texts nor their words as strings meet; Python gets small batches of numbers."""
    from lodestone.plans import documents

    found = getattr(documents, name)(spark, data)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in plan and "words:array<string>" not in plan and "split(" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 or name == "similarity_parts"


def test_letters_of_plain_texts_are_not_counted_by_script(monkeypatch):
    texts = ["the wind came from the north", "Straße und Käse", "123 %", "", "ªº", "µ", "µ and other letters", "Ωmega the end"]
    found = [languages._language(t, t.lower(), languages.PROFILES) for t in texts]
    monkeypatch.setattr(languages, "_PLAIN", regex.compile("(?!)"))
    assert found == [languages._language(t, t.lower(), languages.PROFILES) for t in texts]
    monkeypatch.undo()
    monkeypatch.setattr(languages, "_SCRIPTS", None)
    assert [languages._language(t, t.lower(), languages.PROFILES)[0] for t in texts[:3]] == ["en", "de", None]
