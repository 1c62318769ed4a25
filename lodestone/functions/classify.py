"""Classification of pages, regions and code by the words in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import count_of, literal_array, tokens

# fixed values: indicator words and patterns
CHANGELOG = ("changelog", "change log", r"version \d+\.\d+", "release notes", "what's new", "breaking changes", r"## \[\d+\.\d+\.\d+\]")
RELEASE = ("release", "download", "latest version", "current version", "stable release")
DOCS = ("documentation", "api reference", "user guide", "developer guide", "getting started")
BLOG = ("posted on", "published", "author:", "by [a-zA-Z]+ [a-zA-Z]+", "read more")
CODE_MARKS = ("```", "fn ", "def ", "class ", "import ", "use ", "function", "var ", "let ", "const ", "async fn", "#include", "public class", "struct ", "enum ")
API_MARKS = "api method function parameter return example usage documentation reference endpoint request response struct trait".split()
TUTORIAL_MARKS = ("tutorial", "guide", "step", "how to", "getting started", "introduction", "first", "begin", "start", "learn", "example", "walkthrough", "lesson")
NAVIGATION_MARKS = ("home", "back", "next", "previous", "menu", "index", "table of contents", "toc", "navigation", "nav", "breadcrumb", "sitemap")
LANGUAGE_WORDS = {
    "javascript": ("function ", "const ", "let ", "var ", "=> ", "async ", "await "),
    "python": ("def ", "class ", "import ", "from ", "if __name__", "elif ", "return "),
    "rust": ("fn ", "struct ", "enum ", "trait ", "impl ", "let ", "mut ", "match "),
}
API_STRUCTURES = {
    "rust": ("fn ", "struct ", "enum ", "trait ", "impl "),
    "python": ("def ", "class ", "@property"),
    "javascript": ("function ", "class ", "const ", "interface "),
    "java": ("public class ", "public interface ", "public void ", "public static "),
    "go": ("func ", "type ", "struct ", "interface "),
    "other": ("function", "method", "class"),
}
DOC_WORDS = ("example", "usage", "tutorial", "guide", "documentation", "api", "reference")


def found(text: Column, words) -> Column:
    """How many of the words are in the text."""
    return F.size(F.filter(literal_array(words), lambda w: F.contains(text, w)))


def _any(text: Column, patterns) -> Column:
    return text.rlike("|".join(patterns))


def page_type(text: Column) -> Column:
    lower = F.lower(text)
    return (
        F.when(_any(lower, CHANGELOG), "Changelog")
        .when(found(lower, RELEASE) >= 2, "Release")
        .when(_any(lower, DOCS), "Documentation")
        .when(_any(lower, BLOG), "Blog")
        .otherwise("Other")
    )


def region_type(text: Column) -> Column:
    """Of a paragraph: code, api, tutorial, navigation (short), or text."""
    lower = F.lower(text)
    brackets = F.size(F.regexp_extract_all(text, F.lit(r"[{}()\[\];]"), F.lit(0)))
    code = (found(text, CODE_MARKS) > 0) | (brackets / F.greatest(F.length(text), F.lit(1)) > 0.05)
    return (
        F.when(code, "code")
        .when(found(lower, API_MARKS) >= 2, "api")
        .when(found(lower, TUTORIAL_MARKS) > 0, "tutorial")
        .when((found(lower, NAVIGATION_MARKS) > 0) & (F.length(text) < 100), "navigation")
        .otherwise("text")
    )


def code_language(text: Column) -> Column:
    """The language with most keyword hits, ties by name, null without a hit."""
    scores = [
        F.struct(sum((count_of(text, w) for w in words), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name"))
        for k, (name, words) in enumerate(sorted(LANGUAGE_WORDS.items()))
    ]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["name"])


def api_structures(text: Column, language: str) -> Column:
    return sum((count_of(text, w) for w in API_STRUCTURES.get(language, API_STRUCTURES["other"])), F.lit(0))


def content_quality(text: Column) -> Column:
    n, lower = F.octet_length(text), F.lower(text)
    size = F.when((n > 500) & (n < 50_000), 0.3).when(n >= 200, 0.1).otherwise(0.0)
    headings = F.when(F.contains(text, F.lit("# ")), 0.2).otherwise(0.0)
    code = F.when(F.contains(text, F.lit("```")) | F.contains(text, F.lit("<code>")), 0.2).otherwise(0.0)
    return F.least(size + headings + code + F.least(0.05 * found(lower, DOC_WORDS), F.lit(0.3)), F.lit(1.0))


def difficulty(text: Column) -> Column:
    """1 to 5 by the number of words."""
    n = F.size(tokens(text))
    return F.when(n < 50, 1).when(n < 200, 2).when(n < 500, 3).when(n < 1000, 4).otherwise(5)
