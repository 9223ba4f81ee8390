"""Embedders: functions that add an ``embedding`` column to (…, text)."""
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from docmill import fixed
from docmill.functions.text import collapse_ws, strip


def hashing_embedding(text, dims: int = 64) -> Column:
    """Deterministic unit vector of hashed character 3-grams; no model needed."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        def one(t):
            points = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            counts = np.zeros(dims)
            if points.size > 2:
                shift = np.uint64(21)
                grams = np.unique(((points[:-2] << shift | points[1:-1]) << shift) | points[2:])
                mixed = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                counts = np.bincount((mixed % np.uint64(dims)).astype(np.int64), minlength=dims).astype(np.float64)
            length = np.linalg.norm(counts)
            return (counts / length if length else counts).astype(np.float32)

        return texts.map(one)

    return encode(collapse_ws(F.lower(strip(text))))


@cache
def _model(name: str):
    from sentence_transformers import SentenceTransformer

    return SentenceTransformer(name)


def model_embedding(text, model_name: str = fixed.EMBED_MODEL, batch: int = fixed.EMBED_BATCH) -> Column:
    """Unit vectors of a sentence-transformers model, loaded once per worker."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(model_name)
        for texts in batches:
            vectors = model.encode(
                texts.tolist(), batch_size=batch, show_progress_bar=False, normalize_embeddings=True
            )
            yield pd.Series(list(vectors))

    return encode(text)
