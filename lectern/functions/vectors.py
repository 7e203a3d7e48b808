"""Text vectors. The default embedder needs no model: hashed character pairs, unit length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 64
PAIR_FACTOR = 31


def hash_vector(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Counts of (31 * first + second) mod dims over neighbouring characters, divided by the norm."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    slots = (codes[:-1] * PAIR_FACTOR + codes[1:]) % dims
    counts = np.bincount(slots, minlength=dims).astype(np.float64)
    size = np.sqrt((counts * counts).sum())
    return counts / size if size else counts


def hash_vectors(texts: list[str], dims: int = DIMS, together: int = 256) -> np.ndarray:
    """``hash_vector`` of many texts, a few at a time, as the rows of a matrix."""
    out = np.zeros((len(texts), dims))
    for lo in range(0, len(texts), together):
        some = texts[lo : lo + together]
        codes = np.frombuffer("".join(some).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(some)), [len(t) for t in some])
        slots = row[:-1] * dims + (codes[:-1] * PAIR_FACTOR + codes[1:]) % dims
        counts = np.bincount(slots[row[:-1] == row[1:]], minlength=len(some) * dims).reshape(-1, dims)
        size = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        out[lo : lo + together] = counts / np.where(size == 0, 1, size)
    return out


def batch_embedder(encode: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """Wrap a batch encoder (texts to a matrix) as a column function; rows are normalised."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            mat = np.asarray(encode([t or "" for t in texts]), dtype=np.float64)
            norms = np.linalg.norm(mat, axis=1, keepdims=True)
            mat = (mat / np.where(norms == 0, 1, norms)).astype(np.float32)
            yield pd.Series(list(mat))

    # The return type needs a running session, so the UDF is made when a column asks for it.
    return lambda text: F.pandas_udf(run, "array<float>")(text)


embed_texts = batch_embedder(hash_vectors)
