"""Words, word hashes and shingles of an Arrow text column as arrays.

Everything works on the UTF-8 bytes of a bounded slice of rows at a time, so memory follows
SLICE_BYTES (or the longest single text), not the size of a batch. Null texts count as empty.
Hashes are 64 bits, the same in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at once.
SLICE_BYTES = 1 << 18

_SPACES = [0x20, *range(0x09, 0x0E)]

#: Bytes of a word when words are parted by white space only.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[_SPACES] = False

#: Bytes of a word of ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[ord("0") : ord("9") + 1] = ALNUM[ord("a") : ord("z") + 1] = True
ALNUM[ord("A") : ord("Z") + 1] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Words that are hashed at once.
_WORDS = 1 << 15

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = np.ones(1, dtype=np.uint64)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024), _BASE)]))
    return _powers


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets into them) for runs of rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), len(column))
        yield start, stop, data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        start = stop
    # A worker outlives its task; what Arrow keeps for the next batch would stay beside the executor's heap.
    pa.default_memory_pool().release_unused()


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lower-cased bytes, word starts, word ends, index of each row's first word and one past the last)."""
    data = _LOWER[data]
    inside = kind[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per word, from its bytes."""
    hashes = np.zeros(len(starts), np.uint64)
    # Some arrays hold 8 bytes for each byte of the words, so these are taken by parts.
    for k in range(0, len(starts), _WORDS):
        lengths = ends[k : k + _WORDS] - starts[k : k + _WORDS]
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        values = _BYTE[data[np.repeat(starts[k : k + _WORDS], lengths) + within]] * _powers_to(int(lengths.max()))[within]
        hashes[k : k + _WORDS] = mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))
    return hashes


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `width` words in order, offsets of the rows into them).

    A row with fewer words has one shingle, the whole sequence; a row without words has none.
    """
    counts = np.diff(rows)
    number = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(number)])
    powers = np.multiply.accumulate(np.full(width, _STEP))
    values = np.zeros(int(at[-1]), np.uint64)
    total = len(hashes) - width + 1
    if total > 0:
        rolled = np.zeros(total, np.uint64)
        for j in range(width):
            rolled += hashes[j : j + total] * powers[j]
        place = np.arange(len(values)) + np.repeat(rows[:-1] - at[:-1], number)
        whole = np.repeat(counts >= width, number)
        values[whole] = rolled[place[whole]]
    for m in range(1, width):
        short = np.flatnonzero(counts == m)
        value = np.full(len(short), m, np.uint64) * _BASE
        for j in range(m):
            value += hashes[rows[short] + j] * powers[j]
        values[at[short]] = value
    return mix(values), at


def shingle_rows(column: pa.Array, width: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the column, its shingles in order), words parted by white space, A-Z lower-cased."""
    for start, _, data, offsets in slices(column, limit):
        data, starts, ends, rows = words(data, offsets, NOT_SPACE)
        values, at = shingles(word_hashes(data, starts, ends), rows, width)
        for i in range(len(offsets) - 1):
            yield start + i, values[at[i] : at[i + 1]]
