"""Vectors as rows: which take part, classes of equal ones, and exact cosines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tagged(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding, digest) of every row; the digest is null where a row takes no part.

    Equal vectors have equal digests, whatever the signs of their zeros.
    """

    def digests(frames):
        for frame in frames:
            made = [
                None if vec_id is None or pd.isna(vec_id) else _digest(v)
                for vec_id, v in zip(frame["vec_id"], frame["embedding"], strict=True)
            ]
            yield frame.assign(vec_id=frame["vec_id"].astype("Int64"), digest=made)

    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInPandas(digests, "vec_id long, embedding array<double>, digest binary")


def _digest(vector) -> bytes | None:
    if vector is None:
        return None
    x = np.asarray(vector, np.float64) + 0.0
    if not np.isfinite(x).all() or not x.any():
        return None
    return xxhash.xxh3_128_digest(x.tobytes())


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    return np.stack([np.asarray(v, np.float64) for v in column])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest part first, so that none overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the same row of ``y``, the same wherever it is computed.

    Rows whose squares would overflow or vanish are scaled by a power of two first, which is exact.
    """
    x, y = _ranged(x), _ranged(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _ranged(x: np.ndarray) -> np.ndarray:
    power = np.frexp(np.abs(x).max(axis=1, initial=0.0))[1]
    far = np.abs(power) > 200
    if not far.any():
        return x
    return np.ldexp(x, np.where(far, -power, 0)[:, None])
