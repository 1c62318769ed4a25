"""Statistics, topics and scores of texts, links and libraries as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import count_of, literal_array, once, word_count

# fixed values: weights and the words that are looked for
QUALITY_WEIGHTS = {
    "words": (1000, 0.15), "sentences": (50, 0.10), "word_length": (10, 0.10), "code_blocks": (10, 0.20), "links": (20, 0.15), "headings": (10, 0.15), "complexity": (100, 0.15),
}
RELEVANCE_WORDS = {
    "rust": 1.0, "programming": 0.9, "code": 0.8, "development": 0.8, "software": 0.7, "algorithm": 0.9, "data": 0.6, "function": 0.7, "variable": 0.6, "struct": 0.8,
}
COMPLEX_WORDS = {"if ": 2, "for ": 3, "while ": 3, "match ": 4, "async ": 2, "trait ": 5, "impl ": 4}
TOPICS = ("rust", "javascript", "python", "web", "api", "database", "algorithm", "machine learning", "security", "performance")
LANGUAGES = "rust python javascript typescript java go c++ c# php ruby swift kotlin".split()
TECHNOLOGIES = "react vue angular node express django flask spring tokio actix serde reqwest async await".split()
SUBJECTS = "async programming web api database security testing deployment performance architecture".split()
TEXT_TYPES = (("documentation", ("documentation", "docs")), ("tutorial", ("tutorial", "guide")), ("api_reference", ("api", "reference")), ("example", ("example", "demo")))
AUTHORITIES = ("github.com", "docs.rs", "python.org", "doc.rust-lang.org")
LINK_TYPES = (
    ("Documentation", "doc", "documentation"), ("Tutorial", "tutorial", "tutorial"), ("ApiReference", "api", "api reference"), ("Example", "example", "example"), ("Download", "download", "download"),
)
PRIORITIES = {"Documentation": 5, "ApiReference": 5, "Tutorial": 4, "Example": 4, "Download": 3, "ExternalReference": 3, "Navigation": 2, "Related": 2}
STOP_WORDS = {  # frequent words of each natural language
    "en": "the and of to is that it was for with are this".split(), "fr": "le la les et des est une que dans pour pas sur".split(),
    "de": "der die das und ist nicht ein eine mit auf den von".split(), "es": "el los las una que por con para del es como más".split(),
}


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _those(text: Column, words) -> Column:
    return once(text, lambda t: F.filter(literal_array(words), lambda w: F.contains(t, w)))


def statistics(text: Column, sep: str = "\n\n") -> Column:
    """struct of words (runs of letters and digits), sentences, paragraphs, word_length and sentence_length (means, bytes and words), code_blocks,
    links, headings, complexity (0 to 100)."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    words, parts = F.size(found), F.size(F.split(text, "[.!?]"))
    length = F.octet_length(F.array_join(found, ""))
    complexity = F.least(sum((count_of(text, w) * k for w, k in COMPLEX_WORDS.items()), F.lit(0)), F.lit(100)).cast("double")
    return F.struct(
        words.alias("words"),
        parts.alias("sentences"),
        F.size(F.split(text, sep)).alias("paragraphs"),
        F.coalesce(F.try_divide(length, words), F.lit(0.0)).alias("word_length"),
        (words / parts).alias("sentence_length"),
        F.floor(count_of(text, "```") / 2).cast("int").alias("code_blocks"),
        (count_of(text, "http") + count_of(text, "[")).alias("links"),
        count_of(text, "#").alias("headings"),
        complexity.alias("complexity"),
    )


def plain_statistics(text: Column, sep: str = "\n\n") -> Column:
    """The same names counted without a segmenter: words between white space, sentence marks, length for complexity."""
    words, marks = word_count(text), F.regexp_count(text, F.lit("[.!?]"))
    letters = F.octet_length(F.regexp_replace(text, r"\s+", ""))
    return F.struct(
        words.alias("words"),
        marks.alias("sentences"),
        F.size(F.split(text, sep)).alias("paragraphs"),
        (letters / F.greatest(words, F.lit(1))).alias("word_length"),
        (words / F.greatest(marks, F.lit(1))).alias("sentence_length"),
        F.floor(count_of(text, "```") / 2).cast("int").alias("code_blocks"),
        count_of(text, "http").alias("links"),
        count_of(text, "#").alias("headings"),
        (F.octet_length(text) / 100.0).alias("complexity"),
    )


def statistical_quality(s: Column) -> Column:
    """Capped and weighted statistics, times five, from 1 to 5."""
    score = sum((F.least(s[name], F.lit(top)) / float(top) * weight for name, (top, weight) in QUALITY_WEIGHTS.items()), F.lit(0.0))
    return F.greatest(F.least(score * 5.0, F.lit(5.0)), F.lit(1.0))


def grade(score: Column) -> Column:
    return F.when(score >= 4.5, "excellent").when(score >= 3.5, "good").when(score >= 2.5, "fair").when(score >= 1.5, "poor").otherwise("bad")


def keyword_relevance(text: Column, context: str = "") -> Column:
    """Weighted occurrences over the sum of weights, half a weight for words of the context, at most 1."""
    lower = F.lower(text)
    total = sum((count_of(lower, w) * k for w, k in RELEVANCE_WORDS.items()), F.lit(0.0)) + sum(k * 0.5 for w, k in RELEVANCE_WORDS.items() if w in context.lower())
    return F.least(total / sum(RELEVANCE_WORDS.values()), F.lit(1.0))


def topics(text: Column, most: int = 5) -> Column:
    return F.slice(_those(F.lower(text), TOPICS), 1, most)


def guessed_language(text: Column) -> Column:
    lower = F.lower(text)
    return (
        F.when(_any(lower, ("fn ", "struct ", "impl ")), "Rust")
        .when(_any(lower, ("function ", "const ", "let ")), "JavaScript")
        .when(_any(lower, ("def ", "class ", "import ")), "Python")
        .otherwise("Text")
    )


def recommendations(s: Column, quality: Column) -> Column:
    rules = (
        (s["words"] < 100, "add detail"), (s["headings"] == 0, "add headings"), ((s["code_blocks"] == 0) & (s["words"] > 200), "add code examples"),
        (s["sentence_length"] > 25, "shorten the sentences"), (quality < 3, "improve the content"),
    )
    return F.filter(F.array(*[F.when(test, F.lit(advice)) for test, advice in rules]), lambda x: x.isNotNull())


def composite(s: Column, quality: Column, clarity: Column, depth: Column, usefulness: Column, semantic: Column) -> Column:
    """0.2 of the statistics, 0.6 of the four model scores (0 to 10), 0.2 of the semantic relevance (0 to 1)."""
    basic = F.least(F.least(s["words"], F.lit(1000)) / 100.0 + s["code_blocks"] + s["headings"], F.lit(10.0))
    return F.greatest(F.least(basic * 0.2 + (quality + clarity + depth + usefulness) / 4.0 * 0.6 + semantic * 10.0 * 0.2, F.lit(10.0)), F.lit(0.0))


def score_in_text(text: Column, keyword: str, default: float = 6.0) -> Column:
    """The number out of ten in the hundred characters from a keyword on, from 1 to 10."""

    def of(found: Column) -> Column:
        score = F.regexp_extract(F.substring(found["lower"], found["at"], F.lit(100)), r"(\d+(?:\.\d+)?)\s*[/分]?\s*(?:10|分|点)", 1).try_cast("double")
        return F.when(found["at"] > 0, F.coalesce(F.greatest(F.least(score, F.lit(10.0)), F.lit(1.0)), F.lit(default))).otherwise(F.lit(default))

    return once(F.lower(text), lambda lower: once(F.struct(lower.alias("lower"), F.instr(lower, keyword.lower()).alias("at")), of))


def semantics(text: Column) -> Column:
    """struct of type, languages, technologies, topics and difficulty (1 to 5, by the number of words) from the words in a text."""

    def of(found: Column) -> Column:
        lower, words = found["lower"], found["words"]
        those = lambda listed: F.filter(literal_array(listed), lambda w: F.contains(lower, w))
        kind = F.coalesce(*[F.when(_any(lower, marks), F.lit(name)) for name, marks in TEXT_TYPES], F.lit("unknown"))
        hard = F.when(words <= 50, 1).when(words <= 200, 2).when(words <= 500, 3).when(words <= 1000, 4).otherwise(5)
        return F.struct(kind.alias("type"), those(LANGUAGES).alias("languages"), those(TECHNOLOGIES).alias("technologies"), those(SUBJECTS).alias("topics"), hard.alias("difficulty"))

    return once(F.struct(F.lower(text).alias("lower"), word_count(text).alias("words")), of)


def natural_language(text: Column) -> Column:
    """The language whose frequent words come most often, the first of equals; null where none comes."""
    lower = F.lower(text)
    hits = [F.regexp_count(lower, F.lit(rf"(?<![\p{{L}}])(?:{'|'.join(words)})(?![\p{{L}}])")) for words in STOP_WORDS.values()]
    best = F.greatest(*hits)
    return F.when(best > 0, F.coalesce(*[F.when(h == best, F.lit(name)) for name, h in zip(STOP_WORDS, hits, strict=True)]))


def ascii_only(text: Column) -> Column:
    """Without non-ASCII characters, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]", ""), r"\s+", " "))


def embedding_text(text: Column, most: int = 1500) -> Column:
    """Lines trimmed and joined, cut at the last space before ``most`` characters."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    joined = F.array_join(rows, " ")
    head = F.left(joined, F.lit(most))
    return F.when(F.length(joined) <= most, joined).otherwise(F.concat(F.regexp_replace(head, r"(?s)^(.*) [^ ]*$", "$1"), F.lit("...")))


def library_scores(description: Column, api: Column, tutorials: Column, examples: Column, installation: Column) -> Column:
    """struct of quality and completeness from what a library's documentation has (booleans)."""
    parts = ((description, 0.2, 0.1), (api, 0.3, 0.3), (tutorials, 0.2, 0.2), (examples, 0.2, 0.2), (installation, 0.1, 0.2))
    sums = [sum((F.when(there, p[k]).otherwise(0.0) for there, *p in parts), F.lit(0.0)) for k in (0, 1)]
    return F.struct(F.round(sums[0], 6).alias("quality"), F.round(sums[1], 6).alias("completeness"))


def link_relevance(url: Column, context: Column, library: str, language: str, expected: tuple[str, ...] = ("doc", "tutorial", "example", "api")) -> Column:
    u, c = F.lower(url), F.lower(context)
    has = lambda t, w, value: F.when(F.contains(t, F.lit(w.lower())), value).otherwise(0.0)
    score = has(u, library, 0.4) + has(u, language, 0.3) + has(c, library, 0.2) + F.when(_any(u, AUTHORITIES), 0.2).otherwise(0.0)
    return F.least(sum((has(u, w, 0.1) for w in expected), score), F.lit(1.0))


def link_type(url: Column, context: Column) -> Column:
    u, c = F.lower(url), F.lower(context)
    named = [F.when(F.contains(u, F.lit(a)) | F.contains(c, F.lit(b)), F.lit(kind)) for kind, a, b in LINK_TYPES]
    return F.coalesce(*named, F.when(_any(u, ("github.com", "gitlab.com")), "ExternalReference"), F.lit("Related"))


def link_priority(kind: Column, relevance: Column) -> Column:
    base = F.coalesce(*[F.when(kind == k, p) for k, p in PRIORITIES.items()], F.lit(2))
    return F.when(relevance > 0.7, F.least(base + 1, F.lit(5))).when(relevance < 0.3, F.greatest(base - 1, F.lit(1))).otherwise(base)


def link_context(text: Column, url: Column, reach: int = 3) -> Column:
    """The words up to ``reach`` to either side of the first word that is the URL; empty where it is no word of the text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    at = F.array_position(words, url)
    return F.when(at > 0, F.array_join(F.slice(words, F.greatest(at - reach, F.lit(1)).cast("int"), (F.least(at, F.lit(reach + 1)) + reach).cast("int")), " ")).otherwise("")


def combined_relevance(topic_count: Column, usefulness: Column, context: Column) -> Column:
    return F.least(F.when(topic_count > 0, 0.3).otherwise(0.0) + usefulness * 0.4 + F.when(F.length(context) > 0, 0.3).otherwise(0.0), F.lit(1.0))


def combined_confidence(topic_count: Column, expected_quality: Column, authority: Column, trust: Column) -> Column:
    return (F.when(topic_count > 0, 0.8).otherwise(0.5) + expected_quality + (authority + trust) / 2.0) / 3.0


def backoff_ms(attempt: Column, base: float = 1000.0, factor: float = 2.0, most: float = 30_000.0) -> Column:
    """Delay before an attempt, counted from 1."""
    return F.least(base * F.pow(F.lit(factor), attempt - 1), F.lit(most))


def fragment_preview(content: Column, most: int = 500) -> Column:
    return F.when(F.length(content) > most, F.concat(F.left(content, F.lit(most)), F.lit("..."))).otherwise(content)
