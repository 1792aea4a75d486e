"""Vectorised text kernels on Arrow string columns; numpy only, no Spark.

Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(0x51EED))
BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bytes that end a word: space, tab to carriage return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: For looser words: every ASCII byte that is neither letter nor digit.
PUNCTUATION = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a uint64 array over the word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((BASE, BASE_INVERSE)):
            step = np.full(size, base, U64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, the text of row i being bytes[offsets[i]:offsets[i + 1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    if ends is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes of text at most, or one row."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: sums[i] covers data[:i]."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings data[start:end], wherever they stand."""
    inverse = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * MULTIPLIERS[63])


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of all rows."""
    n = len(data)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    return np.flatnonzero(inside & (~before | edge[:n])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, word offsets by row) of the words of each row, with A-Z as a-z."""
    starts, ends = spans(data, offsets, separators)
    hashes = span_hash(prefix_sums(LOWER[data]), starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, by_row: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by row) of the runs of k words of each row; fewer words are one run, none is none."""
    count = np.diff(by_row)
    total = np.zeros(len(hashes), U64)
    for j in range(k):
        if len(hashes) > j:
            total[: len(hashes) - j] += hashes[j:] * MULTIPLIERS[j]
    short = (count > 0) & (count < k)
    for row in np.flatnonzero(short):
        a, b = by_row[row], by_row[row + 1]
        total[a] = (np.append(hashes[a:b], U64(b - a)) * np.append(MULTIPLIERS[: b - a], MULTIPLIERS[62])).sum(dtype=U64)
    last = np.where(short, by_row[:-1] + 1, np.maximum(by_row[1:] - k + 1, by_row[:-1]))
    runs = last - by_row[:-1]
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(runs, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(by_row[:-1] - out[:-1], runs)
    return mix(total[at]), out


def distinct_shingles(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The set of k-word runs of each text, as sorted hashes."""
    data, offsets = utf8(column)
    hashes, _, _, by_row = words(data, offsets)
    runs, ends = shingles(hashes, by_row, k)
    return [np.unique(runs[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
