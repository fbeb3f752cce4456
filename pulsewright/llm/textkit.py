"""Vectorised text primitives shared by the corpus operators.

Everything here works on UTF-8 bytes in numpy arrays, one bounded chunk of
rows at a time, so a Python worker's memory does not grow with the size of an
Arrow batch.  Hashes are 64-bit and the same in every process and on every
machine (no use of Python's salted ``hash``).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 17

_SEED = np.random.Generator(np.random.PCG64(20240607))
#: A random odd multiplier and a random value per byte for polynomial hashing modulo 2**64.
BASE = np.uint64(int(_SEED.integers(1 << 62, 1 << 63)) | 5)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: everything but ASCII white space (bytes of longer code points are all word bytes).
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words after lower-casing: digits, a-z and all bytes of code points above ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least; grown by doubling and kept."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((BASE, BASE_INV)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] == sum(values[t] * BASE**t for i <= t < j); values are uint64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], independent of where the spans stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def rolling_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """span_hash of every k consecutive values, by first value; empty if there are fewer."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = prefix[k:] - prefix[:n]
    x *= powers(len(prefix))[1][:n]
    x += np.uint64(k)
    return mix(x)


def rows_as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; one long text may be more."""
    raw, at = rows_as_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
    tidy()


_batches = [0]


def tidy(every: int = 16) -> None:
    """Give memory back to the system now and then: workers live on, idle, beside other operators' ones."""
    _batches[0] += 1
    if _batches[0] % every == 0:
        pa.default_memory_pool().release_unused()
        if _LIBC is not None:
            _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: nothing to trim with
    _LIBC = None


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the n + 1 offsets of each row's words."""
    m = np.zeros(len(data) + 2, bool)
    m[1:-1] = is_word[data]
    starts = np.flatnonzero(m[1:-1] & ~m[:-2])
    ends = np.flatnonzero(m[1:-1] & ~m[2:]) + 1
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[m[inner] & m[inner + 1]] if len(inner) else inner  # a word runs over a row's end: it is two words
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(BYTE_VALUE[data]), starts, ends)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, by first word; empty if there are fewer. Rows are not kept apart."""
    return rolling_hash(prefix_hash(words), k)


def whole_grams(row_of: np.ndarray, k: int) -> np.ndarray:
    """Which grams of k words, by first word, lie within one row; row_of: each word's row."""
    return row_of[k - 1 :] == row_of[: len(row_of) - k + 1] if len(row_of) >= k else np.zeros(0, bool)


def row_of_words(word_at: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(word_at) - 1), np.diff(word_at))


#: Bits of a hash that give way to a place when minima are sought.
_PLACE_BITS = 24


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the last minimum (of the upper bits of h) in each window of w values: one for each of the len(h) - w + 1 windows.

    The place stands in the lower bits, the later the less, so one minimum finds
    value and place; long inputs are taken in overlapping parts.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    part = (1 << _PLACE_BITS) - w
    out = np.empty(n, np.int64)
    for s in range(0, n, part):
        own = h[s : min(s + part, n) + w - 1]
        best = own | mask
        best -= np.arange(len(own), dtype=np.uint64)
        size = 1
        while size < w:  # doubling: a window of up to 2 * size is the better of two that overlap
            step = min(size, w - size)
            best = np.minimum(best[:-step], best[step:])
            size += step
        out[s : s + len(best)] = (mask - (best & mask)).astype(np.int64) + s
    return out


def winnow(h: np.ndarray, word_at: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the fingerprints of gram hashes h of all rows (h[i] begins at word i; grams over a row's end are ignored).

    Every run of w consecutive grams of one row holds a fingerprint, so that
    every span of w + k - 1 words does; a row with fewer grams keeps its least.
    """
    n_words = int(word_at[-1])
    if len(h) == 0:
        return np.zeros(0, np.int64)
    row = row_of_words(word_at)
    ok = whole_grams(row, k)
    x = np.where(ok, h, np.uint64(0xFFFFFFFFFFFFFFFF))
    keep = np.zeros(len(h), bool)
    if n_words >= w + k - 1:
        at = window_min(x, w)
        keep[at[whole_grams(row, w + k - 1)]] = True
    n_of = np.diff(word_at)
    for r in np.flatnonzero((n_of >= k) & (n_of < w + k - 1)):
        s, e = int(word_at[r]), int(word_at[r + 1]) - k + 1
        keep[e - 1 - int(np.argmin(x[s:e][::-1]))] = True
    return np.flatnonzero(keep)
