"""Vectorised word handling on the UTF-8 buffers of Arrow string columns.

Every function works on one flat ``uint8`` array that holds many texts, with an offsets array, so
that numpy touches each byte a fixed number of times. All words rules here are stated on bytes; a
byte of 0x80 or more always belongs to a character outside ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about so many bytes; one longer text is a group of its own.
GROUP_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_SPAN = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _byte_values() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)


_VALUES = _byte_values()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_POW = _powers(_BASE, _SPAN + 1)
_POW_INV = _powers(_BASE_INV, _SPAN + 1)


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over byte values, true inside any of the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, values = column.buffers()
    width = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, dtype=width, count=n + 1 + column.offset)[column.offset :].astype(np.int64)
    if values is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(values, dtype=np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def groups(offsets: np.ndarray, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``most`` bytes each, covering every row in order."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes in each text, and n + 1 offsets into them.

    ``is_word``: a table over byte values. A run never crosses from one text into the next.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    stop = inside
    stop[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (one to one)."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. Spans are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    while i < n:
        low = int(starts[i])
        j = max(int(np.searchsorted(ends, low + _SPAN, side="right")), i + 1)
        s, e = starts[i:j] - low, ends[i:j] - low
        if j == i + 1 and e[0] > _SPAN:  # one very long span
            acc = 0
            for at in range(0, int(e[0]), _SPAN):
                part = _VALUES[data[low + at : low + min(at + _SPAN, int(e[0]))]]
                acc = (acc * int(_POW[-1]) + int((part * _POW[: len(part)]).sum(dtype=np.uint64))) & 0xFFFFFFFFFFFFFFFF
            out[i] = acc
        else:
            total = np.zeros(int(e[-1]) + 1, dtype=np.uint64)
            piece = _VALUES[data[low : low + int(e[-1])]]
            piece *= _POW[: len(piece)]
            np.cumsum(piece, out=total[1:])
            out[i:j] = (total[e] - total[s]) * _POW_INV[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of n consecutive items: len(hashes) - n + 1 of them (none if shorter)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    odd = _powers(_U(0xC2B2AE3D27D4EB4F), n + 1)[1:]
    out = hashes[:m] * odd[0]
    for k in range(1, n):
        out += hashes[k : k + m] * odd[k]
    return mix(out)


def inside_rows(word_offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each position of gram_hashes over all texts, whether its n items lie in one text."""
    m = max(total - n + 1, 0)
    ok = np.ones(m, dtype=bool)
    for k in range(1, n):
        at = word_offsets[1:-1] - k
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[i] .. starts[i] + lengths[i] - 1, one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)
