"""Language identification: multinomial naive Bayes over hashed character n-grams.

N-grams are taken over the characters of the text with A-Z lower-cased and runs of other ASCII characters
(digits, punctuation, white space) as one space. Counts of each language over ``2**bits`` buckets come
from a bounded sample of the labelled rows; the log-probability matrix (buckets x languages, bounded
by ``bits`` and MAX_LANGS) is broadcast; batches are scored sparsely: the matrix rows of a text's
n-grams are gathered and summed segment by segment in numpy.

Defined results: bytes of a string that are no UTF-8 become U+FFFD first; null texts and texts without a letter are ``und`` with score 0; null languages are
never learned; with nothing to learn from, every text is ``und``; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import ship_package

BITS = 14
SAMPLE_ROWS = 12_000
MAX_LANGS = 500
ROWS_A_TASK = 2000  # of the bounded sample
PORTION = 1 << 19
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)
_SIZES = ((1, 40503), (2, 2246822519), (3, 3266489917), (4, 668265263))  # characters of an n-gram, and a multiplier of their own


def grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- to 4-grams of the texts' characters, and the number of them that each text has."""
    padded = ["\n" + t + "\n\n\n\n" for t in texts]
    raw = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(padded), dtype=np.int32), np.fromiter(map(len, padded), np.int64, len(padded)))
    raw = np.where(raw < 128, _FOLD[np.minimum(raw, 127)], raw)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32) | (owner[1:] != owner[:-1])
    c, owner = raw[keep], owner[keep]
    n = max(len(c) - 3, 0)
    shift, rolled, mixed = np.uint32(32 - bits), np.zeros(n, np.uint32), []
    for k, (_, multiplier) in enumerate(_SIZES):
        rolled = (rolled ^ (rolled >> np.uint32(13))) * np.uint32(0x01000193) + c[k : k + n]
        mixed.append((rolled * np.uint32(multiplier) ^ (rolled >> np.uint32(15))) * np.uint32(2654435761) >> shift)
    inside = owner[:n] == owner[3 : n + 3]
    return np.stack(mixed, 1)[inside].reshape(-1).astype(np.int64), np.bincount(owner[:n][inside], minlength=len(padded)) * len(_SIZES)


def portions(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about PORTION characters, so that the arrays stay small; a longer text is one run."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= PORTION or k + 1 == len(texts):
            yield start, [x or "" for x in texts[start : k + 1]]
            start, size = k + 1, 0


def fit(docs: DataFrame, labelled: Column, *, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, seed: int = 7):
    """(languages, log-probability matrix) from at most about ``sample_rows`` rows for which ``labelled`` holds.

    The rows are drawn by a hash of doc_id. Each task counts its share; the counts are added on the
    executors bucket by bucket, so the driver gets one number for each language and bucket.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = rows.count()
    share = min(1.0, sample_rows / max(1, total))
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000 + 0.5)
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, part in portions(texts):
                buckets, each = grams(part, bits)
                at = 0
                for lang, n in zip(langs[start : start + len(part)], each, strict=True):
                    own = sums.setdefault(lang, np.zeros(size, np.int64))
                    np.add.at(own, buckets[at : at + n], 1) if n < 64 else own.__iadd__(np.bincount(buckets[at : at + n], minlength=size))
                    at += n
        for lang, own in sums.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(own[some])], names=["lang", "bucket", "n"])

    sample = rows.where(drawn).select("lang", F.make_valid_utf8("text").alias("text")).repartition(max(1, sample_rows // ROWS_A_TASK))
    counts = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    langs: dict[str, np.ndarray] = {}
    for lang, bucket, n in counts.toLocalIterator():
        if lang not in langs and len(langs) >= MAX_LANGS:
            raise ValueError(f"more than {MAX_LANGS} languages")
        langs.setdefault(lang, np.zeros(size))[bucket] = n
    names = sorted(langs)
    if not names:
        return names, np.zeros((size, 0), np.float32)
    table = np.stack([langs[x] for x in names], 1) + 0.5
    return names, np.log(table / table.sum(0)).astype(np.float32)


def predict(docs: DataFrame, model, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (posterior of the predicted language, uniform prior)."""
    spark = docs.sparkSession
    ship_package(spark)
    names, matrix = model
    bits = max(1, int(matrix.shape[0] - 1).bit_length())
    sent = spark.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = sent.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score = [], []
            for _, part in portions(texts):
                l, s = score_batch(part, own, table, bits)
                lang += l
                score += s
            for k, letters in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                if not letters or not own:
                    lang[k], score[k] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-2], "lang_pred", "score"])

    kept = docs.select("doc_id", *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", *keep, letters.alias("__letters"), F.make_valid_utf8("text").alias("__raw")).mapInArrow(run, f"{fields}, lang_pred string, score double")


def score_batch(texts: list[str], names: list[str], table: np.ndarray, bits: int) -> tuple[list[str], list[float]]:
    if not names:
        return ["und"] * len(texts), [0.0] * len(texts)
    buckets, each = grams(texts, bits)
    bounds = np.concatenate(([0], np.cumsum(each)))
    sums = np.empty((len(texts), len(names)))
    some = np.flatnonzero(each)
    for j in range(len(names)):
        sums[:, j] = 0.0
        if len(some):
            sums[some, j] = np.add.reduceat(np.take(table[:, j], buckets), bounds[some], dtype=np.float64)
    best = sums.argmax(1)
    odds = np.exp(sums - sums.max(1, keepdims=True))
    return [names[k] for k in best], list(map(float, odds[np.arange(len(texts)), best] / odds.sum(1)))
