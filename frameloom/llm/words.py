"""Words of a column of texts as numpy arrays: positions and 64-bit hashes, over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Texts are worked on in blocks of about this many bytes; one longer text is a block of its own.
BLOCK_BYTES = 1 << 18


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ U64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are what white space (space, tab to carriage return) leaves.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its texts; null is the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``inside`` bytes, and the first run of each text (n + 1)."""
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edge] = word[edge]
    last[edge[1:] - 1] = word[edge[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each run of bytes; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    power = np.ones(int(lengths.max()) + 1, U64)
    power[1:] = np.cumprod(np.full(len(power) - 1, 0x9E3779B97F4A7C15, U64))
    total = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    taken = data[place + np.repeat(starts, lengths)]
    codes = _BYTE_CODE[_LOWER[taken] if lower else taken] * power[place]
    return mix(np.add.reduceat(codes, total[:-1]) + lengths.astype(U64))


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on (the last ``size`` - 1 entries are missing)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * U64(0x9E3779B97F4A7C15) + U64(k + 1)
        out ^= out >> U64(29)
    return mix(out)
