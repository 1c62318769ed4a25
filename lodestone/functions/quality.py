"""Content quality: readability, coherence, structure and technical scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import literal_array, once, tokens, word_count

# fixed values: phrases and words that the scores count
TRANSITIONS = (
    "however", "therefore", "furthermore", "moreover", "additionally", "consequently", "meanwhile", "similarly",
    "in contrast", "for example", "specifically", "in particular", "as a result", "on the other hand",
)
TECHNICAL_WORDS = (
    "api", "function", "class", "method", "algorithm", "implementation", "configuration", "parameter", "return",
    "example", "usage", "documentation", "tutorial", "guide", "reference", "specification",
)


def sentence_count(text: Column) -> Column:
    """Parts between sentence marks that are not blank."""
    return F.regexp_count(text, F.lit(r"[^.!?\s][^.!?]*"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, "[.!?]"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")


def syllables(text: Column) -> Column:
    """Vowel groups of each word's letters, at least one, a final e of several taken off; counted over the whole text.

    One pattern counts groups but those that end a word in e, and words without such.
    """
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}\s]+", "")
    bare = r"(?<!\S)(?=\S)[^\saeiouy]*+(?:[aeiouy]++(?<=e))?+(?!\S)"  # possessive, so linear in long words
    return F.regexp_count(letters, F.lit(rf"{bare}|[aeiouy]++(?!(?<=e)(?!\S))"))


def readability(text: Column) -> Column:
    """Flesch reading ease over 100, between 0 and 1; 0 without words or sentences."""
    return flesch(word_count(text), sentence_count(text), syllables(text))


def flesch(words: Column, n: Column, syllable_count: Column) -> Column:
    def of(c: Column) -> Column:
        ease = 206.835 - 1.015 * c["words"] / c["n"] - 84.6 * c["syllables"] / c["words"]
        return F.when((c["words"] == 0) | (c["n"] == 0), F.lit(0.0)).otherwise(F.least(F.greatest(ease, F.lit(0.0)), F.lit(100.0)) / 100)

    return once(F.struct(words.alias("words"), n.alias("n"), syllable_count.alias("syllables")), of)


def _likeness(a: Column, b: Column) -> Column:
    """Jaccard of two sets, null if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), once(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both)))


def coherence(text: Column) -> Column:
    """Mean Jaccard of neighbouring sentences' words plus a bonus for transitions; 0.5 below two sentences.

    A word reaches from the first to the last letter between white space. Every sentence is cut into words once.
    """
    word = F.lit(r"\p{L}(?:\S*\p{L})?")
    words = lambda s: F.array_distinct(F.filter(F.regexp_extract_all(s, word, F.lit(0)), lambda w: F.octet_length(w) > 2))
    # no transition begins with another or overlaps itself, so each starts as often as it occurs
    starts = F.lit(f"(?=[{''.join(sorted({t[0] for t in TRANSITIONS}))}])(?={'|'.join(TRANSITIONS)})")

    def of(lower: Column) -> Column:
        sets = F.transform(F.filter(F.split(lower, "[.!?]"), lambda s: s.rlike(r"\S")), words)
        return once(sets, lambda found: scored(lower, found))

    def scored(lower: Column, sets: Column) -> Column:
        n = F.size(sets)
        likes = F.zip_with(F.slice(sets, 1, F.greatest(n - 1, F.lit(1))), F.slice(sets, 2, F.greatest(n - 1, F.lit(1))), _likeness)
        mean = once(F.filter(likes, lambda x: x.isNotNull()), lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda t, y: t + y) / F.size(x)).otherwise(F.lit(0.0)))
        return F.when(n < 2, F.lit(0.5)).otherwise(mean + F.least(F.regexp_count(lower, starts) / n, F.lit(0.3)))

    return once(F.lower(text), of)


def content_score(text: Column, sep: str = "\n\n") -> Column:
    words = tokens(text)
    n, parts = F.size(words), F.size(F.split(text, "[.!?]"))
    paragraphs = F.size(F.split(text, sep))
    mean = n / parts
    distinct = F.when(n > 0, F.size(F.array_distinct(F.transform(words, F.lower))) / n).otherwise(F.lit(0.0))
    points = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0))
    return (
        points(n > 50, 10) + points(n > 200, 10) + points(n > 500, 10) + points(parts > 3, 10) + points(paragraphs > 1, 10)
        + points((mean > 5) & (mean < 25), 20) + points(distinct > 0.3, 20)
    ) / 100.0


def technical_score(text: Column) -> Column:
    return once(F.lower(text), lambda lower: F.size(F.filter(literal_array(TECHNICAL_WORDS), lambda w: F.contains(lower, w)))) / len(TECHNICAL_WORDS)


def completeness(title: Column, body: Column, links: Column, summary: Column, language: Column) -> Column:
    points = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    return (
        points(F.length(title) > 0, 0.2) + points(F.octet_length(body) > 200, 0.3) + points(F.size(links) > 0, 0.2)
        + points(summary.isNotNull(), 0.15) + points(language.isNotNull(), 0.15)
    )


def relevance(code_blocks: Column, tables: Column, links: Column) -> Column:
    points = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(0.0))
    return F.least(0.5 + points(F.size(code_blocks) > 0, 0.2) + points(F.size(tables) > 0, 0.1) + points(F.size(links) > 5, 0.1), F.lit(1.0))


def overall(readable: Column, coherent: Column, complete: Column, relevant: Column, technical: Column) -> Column:
    return 0.3 * readable + 0.2 * coherent + 0.2 * complete + 0.15 * relevant + 0.15 * technical
