"""Small numpy helpers that run inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def as_bytes(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null counts as empty."""
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join i[k] with j[k] for all k. labels points to smaller places only; the result is fully compressed."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            deeper = labels[labels]
            if (deeper == labels).all():
                break
            labels = deeper
