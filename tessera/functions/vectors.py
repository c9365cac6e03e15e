"""Vectors: cosine as an expression, and a hashing embedder as an Arrow-batched function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: offset and prime of the 64-bit FNV-1a hash
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays over the shorter one's length; 0 if either is zero."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(total(x, x) * total(y, y))
    return F.when((n > 0) & (norm > 0), total(x, y) / norm).otherwise(F.lit(0.0))


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def embed_text(text: str | None, dim: int) -> list[float]:
    v = np.zeros(dim, np.float32)
    for t in re.findall(r"[^\W_]+", text or ""):
        v[fnv1a(t.lower().encode()) % dim] += 1.0
    norm = np.sqrt((v * v).sum())
    return (v / norm if norm > 0 else v).tolist()


def hash_embedder(dim: int = 256):
    """A function from a text column to a unit vector of token counts hashed to ``dim`` places."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: embed_text(t, dim))

    return embed
