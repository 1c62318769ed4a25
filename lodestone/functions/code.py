"""Code metrics, suggestions and documentation coverage as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import count_of, lines

# fixed values: control words of each language
CONTROL_WORDS = {
    "rust": "if else match while for loop", "python": "if elif else while for try except", "javascript": "if else while for switch try catch",
    "typescript": "if else while for switch try catch", "java": "if else while for switch try catch", "go": "if else for switch select",
}
OTHER_CONTROL_WORDS = "if else while for"


def line_count(code: Column) -> Column:
    """Lines; a line end at the end opens none."""
    return F.when(F.length(code) == 0, 0).otherwise(F.size(lines(F.regexp_replace(code, "\n$", ""))))


def complexity(code: Column, language: Column) -> Column:
    """1 plus, for each control word, its occurrences before a space, those between spaces counting twice."""
    def hits(words: str) -> Column:
        return sum((count_of(code, f" {w} ") + count_of(code, f"{w} ") for w in words.split()), F.lit(1))

    out = hits(OTHER_CONTROL_WORDS)
    for name, words in CONTROL_WORDS.items():
        out = F.when(language == name, hits(words)).otherwise(out)
    return out


def suggestions(code: Column, language: Column) -> Column:
    script = language.isin("javascript", "typescript")
    rules = [
        (line_count(code) > 50, "split the long function"),
        (complexity(code, language) > 10, "simplify the control flow"),
        ((language == "rust") & F.contains(code, F.lit("unwrap()")), "handle the error instead of unwrap"),
        ((language == "rust") & (count_of(code, "clone()") > 3), "borrow instead of clone"),
        ((language == "python") & F.contains(code, F.lit("except:")), "name the exception"),
        (script & F.contains(code, F.lit("var ")), "declare with let or const"),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(text)) for test, text in rules]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("nothing to suggest")))


def coverage(documented: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(100.0 * documented / total)


def example_quality(stars: Column, text: Column) -> Column:
    """Popularity up to 0.4, length up to 0.3, documentation words up to 0.3; no stars count as one."""
    words = ("example", "parameter", "return", "throws", "see", "note", "warning")  # fixed values
    found = sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.least(F.log10(F.greatest(stars, F.lit(1))) / 10, F.lit(0.4)) + F.least(F.octet_length(text) / 500.0, F.lit(0.3)) + 0.3 * found / len(words)
