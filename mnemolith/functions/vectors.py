"""Cosine similarity: as a column expression, and by numpy for large scans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if lengths differ, either is empty or null, or has norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(usable, dot(a, b) / norm).otherwise(0.0)


def cosine_to(embedding: Column, query: list[float]) -> Column:
    """Cosine of a column of vectors with one query vector, batch by batch in numpy."""
    q = np.array(query, dtype=np.float64)
    q_norm = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def scan(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors))
        fit = np.array([v is not None and len(v) == len(q) and len(q) > 0 for v in vectors], dtype=bool)
        if fit.any() and q_norm > 0:
            m = np.stack(vectors[fit].to_list()).astype(np.float64)
            norms = np.sqrt(np.einsum("ij,ij->i", m, m))
            out[fit] = np.where(norms > 0, m @ q / np.maximum(norms * q_norm, 1e-300), 0.0)
        return pd.Series(out)

    return scan(embedding)


def is_empty(embedding: Column) -> Column:
    return embedding.isNull() | (F.size(embedding) <= 0)
