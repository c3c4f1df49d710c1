"""Hashes of many slices of one byte buffer at once, in numpy.

A polynomial over the bytes modulo 2**64 whose prefix sums give the value of any slice, then a
64-bit finaliser. Equal slices have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = 1 << max(16, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(n, b, _U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place: every input bit moves every output bit."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """uint64 hash of ``data[s:e]`` for each slice."""
    up, down = _power_tables(base, len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.multiply(data, up[: len(data)], out=sums[1:], dtype=_U)
    sums[1:] += up[: len(data)]
    np.cumsum(sums, out=sums)
    out = sums[ends] - sums[starts]
    out *= down[starts]
    out ^= (ends - starts).astype(_U) * _U(0xA0761D6478BD642F)
    return mix(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (nulls as empty) and the n + 1 offsets of its rows in them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n, _, at = len(texts), *texts.buffers()[:2]
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_rows(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges with at most ``most`` bytes each; a longer row stands alone."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes other than 0x20 and 0x09-0x0D, within rows."""
    return runs((data != 32) & ((data < 9) | (data > 13)), offsets)


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of bytes of which ``member`` is true, within rows."""
    inside = np.zeros(len(member) + 2, bool)
    inside[1:-1] = member
    edge = inside[1:] != inside[:-1]
    cut = np.zeros(len(member) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero((edge[: len(member) + 1] | cut)[: len(member)] & inside[1:-1])
    ends = np.flatnonzero((edge | cut)[1:] & inside[1:-1]) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, row


def ragged(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices begin[0], begin[0]+1, ... (n[0] of them), begin[1], ..."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin - (ends - n), n) + np.arange(total)


def blobs(column: pa.Array, dtype) -> list[np.ndarray]:
    """The values of a binary column as arrays on its own memory."""
    column = column.cast(pa.large_binary())
    n, _, at = len(column), *column.buffers()[:2]
    if not n:
        return []
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8).tolist()
    raw = column.buffers()[2]
    width = np.dtype(dtype).itemsize
    return [np.frombuffer(raw, dtype, (b - a) // width, a) if b > a else np.zeros(0, dtype) for a, b in zip(offsets[:-1], offsets[1:])]
