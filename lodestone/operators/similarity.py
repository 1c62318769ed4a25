"""Near-duplicate detection by the weighted document similarity.

Pairs are never formed over a whole table: equal texts are one node, named by their smallest id, and all pairs of nodes whose
sets of lower-cased word bigrams have a Jaccard similarity of ``overlap`` or more are scored (``operators.overlap``: an exact join). A node's
copies come back beside it. The number of pairs is that of similar texts, so a class of n unequal texts gives up to n (n - 1) / 2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULT
from lodestone.functions.text import (
    SEMANTIC_FIELDS, STOP_WORDS, TECHNICAL_TERMS, content_words, cosine_of_digests, document_similarity, jaccard, keywords, lettered, literal_array, normalize,
    structure, structure_similarity, tokens, word_digests,
)
from lodestone.operators import overlap
from lodestone.runtime import TIDY, discard, materialize, settings

_STOP = frozenset(STOP_WORDS)


def term_frequency(docs: DataFrame, *, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """id, word, n, tf: counts of content words over the number of all words. A document's words are counted where it lies, without a shuffle."""
    stop = pa.array(STOP_WORDS)
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                words = pc.split_pattern(part.column(1), " ")
                total, row, word = pc.list_value_length(words).to_numpy(), pc.list_parent_indices(words), words.flatten()
                keep = pc.and_(pc.greater_equal(pc.binary_length(word), 2), pc.invert(pc.is_in(word, value_set=stop)))
                row, coded = row.filter(keep).to_numpy(), word.filter(keep).dictionary_encode()
                size = len(coded.dictionary)
                found, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
                rows = found // max(size, 1)
                tf = pa.array(n / total[rows], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), coded.dictionary.take(pa.array(found % max(size, 1))), pa.array(n, pa.int64()), tf], names=["id", "word", "n", "tf"])

    lower = F.lower(F.coalesce(normalize(F.col(column)), F.lit("")))
    found = docs.select(F.col(id_column).alias("id"), lower.alias("text")).mapInArrow(run, f"id {kind}, word string, n long, tf double")
    return found.select(F.col("id").alias(id_column), "word", "n", F.round("tf", 6).alias("tf"))


def word_bigrams(raw: bytes) -> np.ndarray:
    """Digests of the bigrams of at least four bytes; a lone content word stands for itself, texts without either share one digest."""
    return _bigrams_of_all(pa.array([raw], pa.binary()))[1]


_SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACES] = 0
_BASE, _PAIR, _LONE = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words_of_all(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int], str]]:
    """The text, hash and length of each word, and the way to a word. A hash is a polynomial in numbers that stand for the word's bytes, mixed."""
    n = len(texts)
    texts = pc.fill_null(texts, b"").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    number = _BYTE[raw]
    letter = number != 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(letter & (edge[:-1] | np.concatenate(([True], ~letter[:-1]))[: len(raw)]))
    length = np.diff(np.append(np.cumsum(letter, dtype=np.int64)[starts] - 1, np.count_nonzero(letter)))
    powers = np.cumprod(np.full(length.max(initial=0) + 1, _BASE))
    word = np.zeros(len(starts), np.uint64)
    for k in range(min(len(powers) - 1, 24)):  # a letter of all words that have one there
        at = np.flatnonzero(length > k)
        word[at] += number[starts[at] + k] * powers[k]
    for x in np.flatnonzero(length > 24).tolist():
        word[x : x + 1] += (number[starts[x] + 24 : starts[x] + length[x]] * powers[24 : length[x]]).sum()
    row = np.searchsorted(offsets, starts, side="right") - 1
    return row, _mixed(word), length, lambda x: raw[starts[x] : starts[x] + length[x]].tobytes().decode()


def _bigrams_of_all(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sizes and digests of ``word_bigrams`` of all texts."""
    n = len(texts)
    row, word, length, named = _words_of_all(texts)
    pair = np.flatnonzero((row[1:] == row[:-1]) & (length[1:] + length[:-1] >= 3))
    grams, of = _mixed(word[pair] * _PAIR + word[pair + 1]), row[pair]
    none = np.setdiff1d(np.arange(n), of)
    if len(none):
        words, first = np.bincount(row, minlength=n), np.searchsorted(row, none)
        own = np.full(len(none), _LONE)
        for k, x in enumerate(first.tolist()):
            if words[none[k]] == 1 and length[x] > 1 and named(x) not in _STOP:
                own[k] = word[x]
        grams, of = np.concatenate((grams, _mixed(own))), np.concatenate((of, none))
        order = np.argsort(of, kind="stable")
        grams, of = grams[order], of[order]
    bounds = np.searchsorted(of, np.arange(n + 1)).tolist()
    for a, z in pairwise(bounds):
        grams[a:z].sort()
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])))
    return np.bincount(of[new], minlength=n), grams[new].view(np.int64)


word_bigrams.many = _bigrams_of_all


def _bigrams_and_words(raw: bytes) -> np.ndarray:
    """The size of ``word_bigrams``, these, and the digests of all words of two bytes or more that are no stop words."""
    return _bigrams_and_words_of_all(pa.array([raw], pa.binary()))[1]


def _bigrams_and_words_of_all(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes, grams = _bigrams_of_all(texts)
    row, word, length, _ = _words_of_all(texts)
    _, stop, _, _ = _words_of_all(pa.array([w.encode() for w in STOP_WORDS], pa.binary()))
    kept = (length >= 2) & ~np.isin(word, stop)
    row, word = row[kept], word[kept].view(np.int64)
    n = np.arange(len(sizes))
    of = np.concatenate((n, np.repeat(n, sizes), row))
    return 1 + sizes + np.bincount(row, minlength=len(n)), np.concatenate((sizes, grams, word))[np.argsort(of, kind="stable")]


_bigrams_and_words.many = _bigrams_and_words_of_all


def _bigram_digests(words: Column) -> Column:
    """``ngrams(words, 2)``, 64 bits each."""
    m = F.greatest(F.size(words) - 1, F.lit(0))
    long = lambda a, b: F.when(F.octet_length(a) + 1 + F.octet_length(b) >= 4, F.xxhash64(a, b))
    return F.array_distinct(F.filter(F.zip_with(F.slice(words, 1, m), F.slice(words, 2, m), long), lambda g: g.isNotNull()))


def features(docs: DataFrame, *, sep: str = "\n\n", id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """id, f: what the document similarity compares, computed once for each document; words and bigrams by 64 bits each."""
    t = F.col(column)
    own = docs.select(id_column, F.coalesce(t, F.lit("")).alias(column)).withColumn("__norm", normalize(t)).withColumn("__lower", F.lower("__norm"))
    own = own.withColumn("__words", tokens(F.col("__norm")))
    capital = F.transform(F.filter("__words", lambda w: (F.octet_length(w) > 2) & w.rlike(r"^\p{Lu}")), F.lower)
    listed = F.filter(literal_array(TECHNICAL_TERMS), lambda x: F.contains(F.col("__lower"), x))
    fields = F.array(*[F.greatest(*[F.contains(F.col("__lower"), F.lit(x)) for x in f]) for f in SEMANTIC_FIELDS])
    return own.select(
        id_column,
        F.struct(
            word_digests(content_words(F.col("__words"))).alias("words"),
            _bigram_digests(F.col("__words")).alias("bigrams"),
            F.array_union(listed, capital).alias("terms"),
            fields.alias("fields"),
            structure(t, sep).alias("structure"),
            keywords(t).alias("keywords"),
            F.octet_length(t).alias("bytes"),
            F.size(F.array_distinct(tokens(t))).alias("vocabulary"),
        ).alias("f"),
    )


def compare(a: Column, b: Column, *, enhanced: bool = False) -> Column:
    """The weighted document similarity of two ``features``."""
    lexical = cosine_of_digests(a["words"], b["words"])
    if enhanced:
        both = F.aggregate(F.zip_with(a["fields"], b["fields"], lambda x, y: (x & y).cast("int")), F.lit(0), lambda s, x: s + x)
        more = 0.4 * jaccard(a["bigrams"], b["bigrams"]) + 0.4 * jaccard(a["terms"], b["terms"]) + 0.2 * both / len(SEMANTIC_FIELDS)
        lexical = F.when((a["bytes"] > 100) & (b["bytes"] > 100), 0.7 * lexical + 0.3 * more).otherwise(lexical)
    empty_a, empty_b = a["bytes"] == 0, b["bytes"] == 0
    lexical = F.when(empty_a & empty_b, 1.0).when(empty_a | empty_b, 0.0).otherwise(lexical)
    share = lambda x, y: F.when(F.greatest(x, y) > 0, F.least(x, y) / F.greatest(x, y)).otherwise(F.lit(1.0))
    sizes = F.least(0.6 * share(a["bytes"], b["bytes"]) + 0.4 * share(a["vocabulary"], b["vocabulary"]), F.lit(1.0))
    return 0.4 * lexical + 0.25 * structure_similarity(a["structure"], b["structure"]) + 0.25 * jaccard(a["keywords"], b["keywords"]) + 0.1 * sizes


def near_duplicates(
    docs: DataFrame, *, threshold: float = DEFAULT.duplicate_threshold, least: float = DEFAULT.duplicate_overlap, sep: str = "\n\n", id_column: str = "doc_id", column: str = "text",
) -> DataFrame:
    """left_id, right_id, similarity, same_text: pairs of unequal texts at or over the threshold, and each copy beside the smallest id of its text."""
    spark = docs.sparkSession
    given = docs.where(F.length(column) > 0)
    rows = given.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc"), F.col(column).alias("text")).withColumn("id", F.xxhash64("text"))
    with settings(spark, TIDY):
        members = materialize(rows.select("id", "doc").distinct(), "members")
        first = materialize(members.groupBy("id").agg(F.min("doc").alias("node")), "first-ids")
        words = materialize(rows.select("id", F.lower(lettered(F.col("text"))).alias("text")), "words")

        def own(named: DataFrame) -> DataFrame:
            texts = rows.join(named.join(first, "id"), "id").where("doc = node").select("id", "text")
            # a number of its own, as few bytes of text are much work
            texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").dropDuplicates(["id"])
            f = features(texts, sep=sep, id_column="id", column="text")
            f = materialize(f.select("id", *[F.col("f")[k].alias(k) for k in ("structure", "keywords", "bytes", "vocabulary")]), "features")
            numbers = [F.col(c) for c in ("node", "bytes", "vocabulary", *(f"structure.{k}" for k in STRUCTURE))] + [F.size("keywords")]
            lists = F.concat(word_digests(F.col("keywords")), F.array(*[c.cast("long") for c in numbers]))
            return f.join(first, "id").select("id", lists.alias("own"))

        pairs = overlap.similar_pairs(words, word_bigrams, least, _bigrams_and_words, own, _scores(threshold))
        discard(words)
    scored = pairs.withColumn("similarity", F.round("similarity", 6)).where(F.col("similarity") >= threshold)
    scored = scored.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "similarity", F.lit(False).alias("same_text"))
    copies = members.join(first, "id").where("node < doc").select(F.col("node").alias("left_id"), F.col("doc").alias("right_id"), F.lit(1.0).alias("similarity"), F.lit(True).alias("same_text"))
    return scored.union(copies.where(F.col("similarity") >= threshold))


STRUCTURE = ("paragraphs", "code_blocks", "list_lines")
_TAIL = 7  # node, bytes, vocabulary, the three of the structure, the number of keywords


def _scores(threshold: float) -> Callable[[pa.ListArray], overlap.Step]:
    """``compare`` for the pairs of a cell; those surely under the threshold go. The lists: digests of all content words, digests of keywords, _TAIL numbers."""

    def prepare(held: pa.ListArray) -> overlap.Step:
        flat, offsets = held.values.to_numpy(), held.offsets.to_numpy().astype(np.int64)
        tail = flat[offsets[1:][:, None] + np.arange(-_TAIL, 0)]
        n, keys = len(tail), tail[:, 6]
        row = np.repeat(np.arange(n), np.diff(offsets))
        rest = offsets[row + 1] - _TAIL - np.arange(len(flat))  # what comes before the numbers, counted from there
        keyword, word = (rest > 0) & (rest <= keys[row]), rest > keys[row]
        distinct, code = np.unique(flat, return_inverse=True)
        # a list's entries: 0 and its words, then 0 and its keywords; no mark is ever set at 0, so none is empty
        coded = np.concatenate([2 * row * (len(distinct) + 1), (2 * row[word]) * (len(distinct) + 1) + code[word] + 1, (2 * np.arange(n) + 1) * (len(distinct) + 1), (2 * row[keyword] + 1) * (len(distinct) + 1) + code[keyword] + 1])
        entry, count = np.unique(coded, return_counts=True)
        half, code = entry // (len(distinct) + 1), entry % (len(distinct) + 1)
        count = np.where(code == 0, 0, count).astype(float)
        halves = np.bincount(half, minlength=2 * n)
        sizes, words = halves[::2] + halves[1::2], halves[::2]
        starts = np.cumsum(sizes) - sizes
        norm = np.sqrt(np.bincount(half, count**2, 2 * n)[::2])
        mark = np.zeros(len(distinct) + 1)

        def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            top = np.maximum(a, b)
            return np.where(top > 0, 1.0 - np.abs(a - b) / np.where(top > 0, top, 1), 1.0)

        def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            top = np.maximum(a, b)
            return np.where(top > 0, np.minimum(a, b) / np.where(top > 0, top, 1), 1.0)

        def step(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            dot, both = np.zeros(len(left)), np.zeros(len(left))
            for x, a, z, at, first in overlap.meetings(left, right, sizes):
                at_word = slice(starts[x], starts[x] + words[x])
                at_key = slice(at_word.stop, starts[x] + sizes[x])
                cuts = np.stack((first, first + words[left[a:z]]), axis=1).ravel()
                partners, times = code[at], count[at]
                mark[code[at_word]] = count[at_word]
                dot[a:z] = np.add.reduceat(mark[partners] * times, cuts)[::2]
                mark[code[at_word]] = 0
                mark[code[at_key]] = count[at_key]
                both[a:z] = np.add.reduceat(mark[partners] * times, cuts)[1::2]
                mark[code[at_key]] = 0
            a, b = tail[left], tail[right]
            norms = norm[left] * norm[right]
            lexical = np.where(norms > 0, np.minimum(dot / np.where(norms > 0, norms, 1), 1.0), ((norm[left] == 0) & (norm[right] == 0)).astype(float))
            structure = (((0.0 + ratio(a[:, 3], b[:, 3])) + ratio(a[:, 4], b[:, 4])) + ratio(a[:, 5], b[:, 5])) / 3
            union = a[:, 6] + b[:, 6] - both
            alike = np.where(union > 0, both / np.where(union > 0, union, 1), 1.0)
            sizes_alike = np.minimum(0.6 * share(a[:, 1], b[:, 1]) + 0.4 * share(a[:, 2], b[:, 2]), 1.0)
            similarity = 0.4 * lexical + 0.25 * structure + 0.25 * alike + 0.1 * sizes_alike
            kept = np.flatnonzero(similarity >= threshold - 1e-6)
            return kept, {"left_id": a[kept, 0], "right_id": b[kept, 0], "similarity": similarity[kept]}

        return step

    return prepare


def duplicate_decision(existing: DataFrame, new: DataFrame, keys: list[str], *, threshold: float = DEFAULT.duplicate_threshold, version: str = "version", content: str = "content") -> DataFrame:
    """New rows with ``duplicate``: the same key and version hold a text at least that similar. Only unequal texts of one key and version are compared."""
    old = existing.select(*keys, F.col(version).alias("__version"), F.col(content).alias("__content"))
    asked = (F.col("__version") == F.col(version)) & (F.col("__content") != F.col(content))
    equal = (F.col("__version") == F.col(version)) & (F.col("__content") == F.col(content)) & F.lit(threshold <= 1)
    # what is not asked for is null before words are cut, as a Python function's input is made for every row
    similar = document_similarity(F.when(asked, F.col("__content")), F.when(asked, F.col(content))) >= threshold
    same = F.coalesce(equal, F.lit(False)) | (asked & similar)
    return new.join(old, keys, "left").withColumn("duplicate", F.coalesce(same, F.lit(False))).drop("__version", "__content")
