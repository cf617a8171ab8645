"""Vectorised words and polynomial hashes over Arrow string columns.

Operators hand Arrow batches to these helpers inside Spark tasks. A batch is
walked in blocks of whole rows of about ``BLOCK_BYTES`` bytes of text, so the
working memory of a task follows the block (or its longest text), not the
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh64_intdigest

BLOCK_BYTES = 2 << 20

_U = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table of the 256 byte values, true outside the given ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: bytes of words that white space separates, and bytes of lower-case words
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
WORD_BYTES = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

#: A-Z to a-z, every other byte to itself
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (the SplitMix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, _U(b), dtype=_U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (both[0], both[1])
    return have


def poly_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of each span [start, end) of 64-bit codes."""
    up, down = powers(base, len(codes))
    sums = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about ``size`` bytes of text: rows, bytes, offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = column_bytes(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of each row, and first word of each row (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = inside[data]
    begins, ends = m.copy(), m.copy()
    begins[1:] &= ~m[:-1]
    ends[:-1] &= ~m[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = m[edge]
    ends[edge - 1] = m[edge - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets, "left")


_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)
#: words beyond so many bytes are hashed one by one
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes; hashes of different seeds are independent.

    Eight bytes at a time are mixed into the state, so that no structure of a
    word (as periods and complements have for polynomials) survives.
    """
    if not len(starts):
        return np.zeros(0, _U)
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    state = mix(sizes.astype(_U) + _U((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    who = np.flatnonzero(sizes <= LONG_WORD)
    at, rest = starts[who], sizes[who]
    while len(who):
        lane = lanes[at] & _TAILS[np.minimum(rest, 8)]
        state[who] = mix((state[who] ^ lane) * _U(0xFF51AFD7ED558CCD))
        more = rest > 8
        who, at, rest = who[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        state[k] = xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return state


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Mask of the positions 0..n-1 that spans of the given lengths cover."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + length, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start..start+length-1."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - at, lengths)
