"""Vectorised text kernels over Arrow batches: byte buffers, word bounds and word hashes in NumPy.

The word hashes are polynomial sums of random per-byte values over the whole buffer of a batch, taken between word
bounds and moved to the word's start, so that a batch costs a few passes whatever the number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

np.seterr(over="ignore")  # hashes wrap around
_RANDOM = np.random.default_rng(20240917)
_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
#: Powers are kept for so many bytes; longer buffers are handled in slices of it.
SLICE = 1 << 20
#: ASCII white space: blank and \\x09 to \\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: np.uint64) -> np.ndarray:
    out = np.empty(SLICE + 1, np.uint64)
    out[0], size = 1, 1
    while size <= SLICE:  # each round doubles what is known
        more = min(size, SLICE + 1 - size)
        out[size : size + more] = out[:more] * (out[size - 1] * base)
        size += more
    return out


_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null has no bytes."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words are runs without ASCII white space; first[d] is the number of words before row d."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not _POWERS:
        _POWERS.update(up=_powers(_BASE), down=_powers(_INVERSE))
    up, down = _POWERS["up"], _POWERS["down"]
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + SLICE, "right")))
        if ends[to - 1] - low > SLICE:  # one word longer than a slice
            out[at] = _long_hash(data[low : ends[at]])
            at += 1
            continue
        part = _VALUES[data[low : ends[to - 1]]]
        part *= up[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * down[a]
        at = to
    return mix(out)


def _long_hash(word: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for k in range(0, len(word), SLICE):
        part = _VALUES[word[k : k + SLICE]] * _POWERS["up"][: len(word[k : k + SLICE])]
        total = (total + scale * int(part.sum(dtype=np.uint64))) % 2**64
        scale = scale * int(_POWERS["up"][SLICE]) % 2**64
    return np.uint64(total)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row) of every window of ``size`` words that lies within one row, in order."""
    n = len(hashes) - size + 1
    counts = np.diff(first)
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = hashes[:n].copy()
    for k in range(1, size):
        keys *= np.uint64(0xD6E8FEB86659FD93)
        keys += hashes[k : n + k]
    row = np.repeat(np.arange(len(counts)), counts)
    inside = row[:n] == row[size - 1 :]
    return mix(keys[inside]), row[:n][inside]


def slices(batches, column: str, most: int = 1_000_000):
    """Arrow batches cut into runs of rows with about ``most`` bytes of text each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = buffer_of(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of true flags of each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])
