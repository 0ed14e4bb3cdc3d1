"""Words and shingles of Arrow text columns as numpy arrays of 64-bit hashes.

Works on UTF-8 bytes: separators are ASCII, so bytes from 0x80 up belong to words.
Hashing runs over slices of about half a MB, so temporary arrays stay small whatever
the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ctypes

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words of everything but ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False

_SLICE = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed * 2 + 1)) | _U(1)


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _power(name: str, p: int, n: int) -> np.ndarray:
    if name not in _cache or len(_cache[name]) < n:
        made = _powers(p, max(n, 1 << 12))
        if n > 2 * _SLICE:
            return made
        _cache[name] = made
    return _cache[name]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each text's first word (one more entry than texts)."""
    n = len(data)
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    table, out, i = _table(seed), np.empty(len(starts), _U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SLICE, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(table[data[lo:hi]] * _power("p", _P, hi - lo)[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * _power("q", _P_INVERSE, hi - lo + 1)[s] + (e - s).astype(_U))
        i = j
    return out


def grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a text, and the word where each starts."""
    counts = np.diff(first)
    m = max(len(words) - k + 1, 0)
    out = np.zeros(m, _U)
    for i in range(k):
        out = mix(out * _U(_P) + words[i : i + m] + _U(i))
    keep = np.ones(m, bool)
    for i in range(1, k):  # runs that cross into the next text
        cut = first[1:] - i
        cut = cut[(cut >= 0) & (cut < m)]
        keep[cut] = False
    short = np.flatnonzero(counts < k)
    for d in short:
        keep[first[d] : min(first[d + 1], m)] = False
    at = np.flatnonzero(keep)
    return out[at], at


def pieces(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of whole rows of about ``most`` bytes of text at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        i, column = 0, batch.column(batch.schema.get_field_index("text"))
        _, offsets = flat(column)
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def text_words(batch: pa.RecordBatch, is_word: np.ndarray):
    """Lower-cased bytes, word starts, word ends and first words of a batch's ``text``."""
    data, offsets = flat(batch.column(batch.schema.get_field_index("text")))
    data = LOWER[data]
    return (data, *bounds(data, offsets, is_word))


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not this C library
    _trim = None


def release() -> None:
    """Give memory that a task no longer needs back to the system: workers serve many tasks, and others share the machine."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)
