"""Text functions as column expressions: words, n-grams, normalisation, structure, keywords.

Lengths that stand for sizes are bytes (``octet_length``); cuts are by characters, so none splits a letter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.runtime import ship_package

# fixed values: the word lists that the scores depend on
STOP_WORDS = """the a an and or but in on at to for of with by is are was were be been being have has had do does did will
would could should may might can this that these those i you he she it we they me him her us them my your his its our
their from up about into through during before after above below between among within without under over""".split()
TECHNICAL_TERMS = """api sdk framework library function method class interface async await promise callback closure lambda
generic template memory thread process concurrency parallelism synchronization mutex lock atomic volatile pointer reference
ownership compilation runtime virtual machine garbage collection serialization deserialization encoding decoding protocol
http https tcp udp websocket database sql nosql""".split()
SEMANTIC_FIELDS = (
    ("rust", "cargo", "crate", "rustc"),
    ("python", "pip", "conda", "pypi"),
    ("javascript", "npm", "node", "yarn"),
    ("memory", "allocation", "heap", "stack"),
    ("async", "await", "concurrent", "parallel"),
    ("api", "endpoint", "request", "response"),
)
KEYWORD_GROUPS = (
    "function method class struct enum trait interface module package library framework",
    "string integer boolean array vector hashmap option result future stream",
    "async await impl pub use mod crate extern unsafe mut ref move clone",
    "api endpoint request response http json xml rest graphql websocket",
)
IMPORTANT_WORDS = ("function", "class", "method", "api", "example", "usage")


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def once(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: what a lambda or a branch names several times is computed each time."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def tokens(text: Column) -> Column:
    """Runs between white space; none in null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def lettered(text: Column) -> Column:
    """Letters, digits, common punctuation and white space only."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\s.,!?;:()\[\]{}\"']", "")


def normalize(text: Column) -> Column:
    """Letters, digits, common punctuation and single spaces only."""
    return F.trim(F.regexp_replace(lettered(text), r"\s+", " "))


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_words(words: Column) -> Column:
    """Lower-cased words of two bytes or more that are no stop words; repeats stay."""
    return F.filter(F.transform(words, F.lower), lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP_WORDS))


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams of at least four bytes; none where there are fewer than n words."""
    m = F.greatest(F.size(words) - n + 1, F.lit(0))
    grams = F.slice(words, 1, m)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(words, k + 1, m), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.filter(grams, lambda g: F.octet_length(g) >= 4))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: two empty ones are alike, one empty set is like nothing."""
    return once(F.size(F.array_union(a, b)), lambda union: F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union))


def technical_terms(text: Column) -> Column:
    lower = F.lower(text)
    listed = F.filter(literal_array(TECHNICAL_TERMS), lambda t: F.contains(lower, t))
    capital = F.filter(tokens(text), lambda w: (F.octet_length(w) > 2) & w.rlike(r"^\p{Lu}"))
    return F.array_union(listed, F.transform(capital, F.lower))


def keywords(text: Column) -> Column:
    """Words of the four keyword groups in the lower-cased text, and identifiers with a capital or an underscore."""
    words = "|".join(w for g in KEYWORD_GROUPS for w in g.split())  # whole words, so one pass finds those of all groups
    listed = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z][a-zA-Z0-9_]*[a-zA-Z0-9](?![\p{L}\p{N}_])"), F.lit(0))
    names = F.filter(names, lambda x: (F.length(x) > 3) & x.rlike("[A-Z_]"))
    return F.array_distinct(F.concat(listed, F.transform(names, F.lower)))


def count_of(text: Column, part: str) -> Column:
    """Times that ``part`` occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def structure(text: Column, sep: str = "\n\n") -> Column:
    """struct(paragraphs, code_blocks, list_lines)."""
    paragraphs = F.size(F.filter(F.split(text, sep), lambda p: p.rlike(r"\S")))
    fences = F.floor(count_of(text, "```") / 2).cast("int")
    listed = F.size(F.filter(lines(text), lambda x: x.rlike(r"^\s*(- |\* |[0-9])")))
    return F.struct(paragraphs.alias("paragraphs"), fences.alias("code_blocks"), listed.alias("list_lines"))


def ratio(a: Column, b: Column) -> Column:
    """1 - |a - b| / max, 1 where both are 0."""
    top = F.greatest(a, b)
    return F.when(top > 0, 1.0 - F.abs(a - b) / top).otherwise(F.lit(1.0))


def structure_similarity(a: Column, b: Column) -> Column:
    return sum((ratio(a[k], b[k]) for k in ("paragraphs", "code_blocks", "list_lines")), F.lit(0.0)) / 3


def of_sizes(la: Column, lb: Column, va: Column, vb: Column) -> Column:
    """The similarity of two texts' bytes and numbers of different words."""
    share = lambda x, y: F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(F.lit(1.0))
    return F.when((la == 0) & (lb == 0), F.lit(1.0)).otherwise(F.least(0.6 * share(la, lb) + 0.4 * share(va, vb), F.lit(1.0)))


def complexity_similarity(a: Column, b: Column) -> Column:
    vocabulary = lambda t: F.size(F.array_distinct(tokens(t)))
    return of_sizes(F.octet_length(a), F.octet_length(b), vocabulary(a), vocabulary(b))


def word_digests(words: Column) -> Column:
    """64 bits for each word, by which words are compared: eight bytes are moved, and no strings reach Python."""
    return F.transform(words, lambda w: F.xxhash64(w))


def cosine_of_digests(a: Column, b: Column) -> Column:
    """Cosine of the counts of two arrays of ``word_digests``: two empty ones 1, one empty 0."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)  # and keep batches small
    return _cosine(a, b)


@F.pandas_udf(T.DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """All rows of a batch are counted at once."""
    n, sides = len(a), []
    distinct, words = np.unique(np.concatenate([np.asarray(x, np.int64) for s in (a, b) for x in (*s, [])]), return_inverse=True)
    at = 0
    for s in (a, b):
        sizes = s.map(len).to_numpy(np.int64)
        keys, counts = np.unique(np.repeat(np.arange(n), sizes) * (len(distinct) + 1) + words[at : at + sizes.sum()], return_counts=True)
        at += sizes.sum()
        rows = keys // (len(distinct) + 1)
        sides.append((keys, counts.astype(float), np.sqrt(np.bincount(rows, counts.astype(float) ** 2, n))))
    (ka, ca, na), (kb, cb, nb) = sides
    both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    dot, norms = np.bincount(both // (len(distinct) + 1), ca[i] * cb[j], n), na * nb
    return pd.Series(np.where(norms > 0, np.minimum(dot / np.where(norms > 0, norms, 1), 1.0), ((na == 0) & (nb == 0)).astype(float)))


def semantic_similarity(a: Column, b: Column) -> Column:
    la, lb = F.lower(a), F.lower(b)
    any_of = lambda t, terms: F.greatest(*[F.contains(t, F.lit(x)) for x in terms])
    return sum(((any_of(la, f) & any_of(lb, f)).cast("int") for f in SEMANTIC_FIELDS), F.lit(0)) / len(SEMANTIC_FIELDS)


def lexical_similarity(a: Column, b: Column) -> Column:
    """Bigrams 0.4, technical terms 0.4, semantic fields 0.2, on normalised texts."""
    na, nb = normalize(a), normalize(b)
    grams = jaccard(ngrams(tokens(na), 2), ngrams(tokens(nb), 2))
    return 0.4 * grams + 0.4 * jaccard(technical_terms(na), technical_terms(nb)) + 0.2 * semantic_similarity(na, nb)


def of_lengths(similarity: Column, a: Column, b: Column) -> Column:
    """``similarity`` of two texts of these lengths: 1 where both are empty, 0 where one is."""
    return F.when((a == 0) & (b == 0), F.lit(1.0)).when((a == 0) | (b == 0), F.lit(0.0)).otherwise(similarity)


def text_similarity(a: Column, b: Column, enhanced: bool = False) -> Column:
    digests = lambda t: word_digests(content_words(tokens(normalize(t))))
    cosine = cosine_of_digests(digests(a), digests(b))
    if enhanced:
        long = (F.octet_length(a) > 100) & (F.octet_length(b) > 100)
        cosine = F.when(long, 0.7 * cosine + 0.3 * lexical_similarity(a, b)).otherwise(cosine)
    return of_lengths(cosine, F.length(a), F.length(b))


def document_similarity(a: Column, b: Column, *, enhanced: bool = False, sep: str = "\n\n") -> Column:
    """Text 0.4, structure 0.25, keywords 0.25, complexity 0.1."""
    return (
        0.4 * text_similarity(a, b, enhanced)
        + 0.25 * structure_similarity(structure(a, sep), structure(b, sep))
        + 0.25 * jaccard(keywords(a), keywords(b))
        + 0.1 * complexity_similarity(a, b)
    )
