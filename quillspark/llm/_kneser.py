"""N-gram keys and packed blocks of texts for the quality classifier's language model; numpy, pandas and Arrow only, no Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from . import _text as T

#: A key is exact: ORDER symbols as a number to the base SYMBOLS. Symbols are the bytes of UTF-8 and START before a text.
ORDER, SYMBOLS, START = 5, 257, 256


def keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One key per byte of all rows, from the ORDER - 1 symbols before it in its row and itself."""
    count, pad = np.diff(offsets), ORDER - 1
    padded = np.full(len(data) + pad * len(count), START, np.int64)
    place = np.arange(len(data)) + np.repeat((np.arange(len(count)) + 1) * pad, count)
    padded[place] = data
    key = np.zeros(max(len(padded) - pad, 0), np.int64)
    for j in range(ORDER):
        key *= SYMBOLS
        key += padded[j : len(padded) - pad + j]
    return key[place - pad]


def pack_keys(key: np.ndarray) -> bytes:
    """Sorted distinct keys, as compressed differences."""
    steps = np.diff(np.sort(key), prepend=0)
    return len(steps).to_bytes(8, "little") + pa.compress(steps.astype("<i8").view(np.uint8).reshape(-1, 8).T.copy().tobytes(), codec="zstd", asbytes=True)


def unpack_keys(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(raw.reshape(8, n).T.copy().view("<i8").ravel())


def score(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Cost in bits of each row, ``bits`` being the costs of the keys ``known``, among which are all of the rows'."""
    index = pd.Index(known)
    out = np.zeros(len(offsets) - 1)
    start = 0
    while start < len(out):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        at = index.get_indexer(keys(data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]))
        sums = np.concatenate([[0.0], np.cumsum(bits[at], dtype=np.float64)])
        out[start:end] = np.diff(sums[offsets[start : end + 1] - offsets[start]])
        start = end
    return out


def distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, bytes, sizes) of a column of texts."""
    data, offsets = T.utf8(column)
    return pd.unique(keys(data, offsets)), data, np.diff(offsets)
