"""Dense vectors: distances as column expressions, and an offline embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def l2_distance(a: Column, b: Column) -> Column:
    """Null where the dimensions differ."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(squares)))


def cosine(a: Column, b: Column) -> Column:
    """0 where the dimensions differ or a vector is all zero."""
    dot = _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
    bottom = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (bottom == 0) | bottom.isNull(), F.lit(0.0)).otherwise(dot / bottom)


def mock_embedding(dimension: int):
    """Deterministic stand-in for an embedding service: the text's bytes as digits of base 31 modulo 2**64
    start a sawtooth of period 1000, scaled to length 1."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        steps = np.arange(dimension, dtype=np.uint64)
        for texts in batches:
            out = []
            for text in texts:
                digits = np.frombuffer((text or "").encode(), np.uint8)
                powers = np.cumprod(np.full(len(digits), 31, np.uint64))
                digest = digits[-1:].astype(np.uint64).sum() + (digits[:-1][::-1].astype(np.uint64) * powers[:-1]).sum()
                raw = ((digest.astype(np.uint64) + steps) % np.uint64(1000)) / 1000.0
                norm = float(np.sqrt((raw * raw).sum()))
                out.append((raw / norm if norm else raw).tolist())
            yield pd.Series(out)

    return embed
