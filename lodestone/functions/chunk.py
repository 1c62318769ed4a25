"""Cutting documents into chunks, with keywords and an importance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import IMPORTANT_WORDS, tokens


def paragraph_chunks(text: Column, size: int = 1000, overlap: int = 100, sep: str = "\n\n") -> Column:
    """array<string>: paragraphs gathered up to ``size`` characters, each chunk opening with the end of the one before."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def add(state: Column, paragraph: Column) -> Column:
        cur = state["cur"]
        full = (F.length(cur) + F.length(paragraph) > size) & (F.length(cur) > 0)
        tail = F.when(F.length(cur) > overlap, F.right(cur, F.lit(overlap))).otherwise(F.lit(""))
        base = F.when(full, tail).otherwise(cur)
        joined = F.when(F.length(base) > 0, F.concat(base, F.lit(sep), paragraph)).otherwise(paragraph)
        return F.struct(joined.alias("cur"), F.when(full, F.concat(state["out"], F.array(cur))).otherwise(state["out"]).alias("out"))

    def close(state: Column) -> Column:
        return F.when(F.length(state["cur"]) > 0, F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"])

    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.aggregate(F.split(text, sep), start, add, close))


def fixed_chunks(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    """array<string>: windows of ``size`` characters, each ``overlap`` into the one before; the last ends the text."""
    step = max(1, size - overlap)
    n = F.greatest(F.ceil((F.length(text) - size) / F.lit(step)), F.lit(0)) + 1
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: F.substring(text, k * step + 1, F.lit(size)))
    )


def chunk_keywords(text: Column, n: int = 10) -> Column:
    """The first ``n`` words of more than three bytes, lower-cased."""
    return F.transform(F.slice(F.filter(tokens(text), lambda w: F.octet_length(w) > 3), 1, n), F.lower)


def importance(text: Column) -> Column:
    lower = F.lower(text)
    found = sum((F.contains(lower, F.lit(w)).cast("int") for w in IMPORTANT_WORDS), F.lit(0))
    return F.least(F.least(F.octet_length(text) / 1000.0, F.lit(0.3)) + 0.1 * found, F.lit(1.0))
