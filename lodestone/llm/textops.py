"""Vectorised tokenising and hashing over Arrow batches of texts.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D);
only A-Z are lower-cased. A null text counts as empty. Hashes are 64 bits wide
and the same on every machine, so equal texts hash equally everywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
_LONG = 512  # bytes; longer words are hashed one by one

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LETTER = np.zeros(256, dtype=bool)  # ASCII letters and digits, and all beyond ASCII
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    LETTER[_a:_b] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> _S30)) * _M1
    h = (h ^ (h >> _S27)) * _M2
    return h ^ (h >> _S31)


_COEF = mix(np.arange(1, 65, dtype=np.uint64) * _STEP) | np.uint64(1)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pad_lower(data: np.ndarray) -> np.ndarray:
    """Lower-cased copy with eight spare bytes, for unaligned 8-byte loads."""
    out = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=out[: len(data)])
    return out


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that cross no offset."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_spans(padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each padded[start:end]."""
    size = end - start
    words = np.ndarray((max(len(padded) - 7, 0),), np.uint64, padded, strides=(1,))
    h = mix(size.astype(np.uint64) + _STEP)
    active = np.flatnonzero(size <= _LONG)
    done = 0
    while len(active):
        left = np.minimum(size[active] - done, 8)
        h[active] = mix((h[active] ^ (words[start[active] + done] & _MASK[left])) * _STEP)
        done += 8
        active = active[size[active] > done]
    for i in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(padded[start[i] : end[i]].tobytes(), digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and bounds so that text i has hashes[bounds[i]:bounds[i + 1]]."""
    padded = pad_lower(data)
    start, end = spans(~_SPACE[data], offsets)
    return hash_spans(padded, start, end), np.searchsorted(start, offsets)


def lower_letters(data: np.ndarray) -> np.ndarray:
    """As pad_lower, but also lower-cases the accented capitals of Latin-1."""
    out = pad_lower(data)
    body = out[: len(data)]
    capital = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)) + 1
    body[capital] += 32
    return out


def letter_words(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the runs of letters and digits, lower-cased; bounds of the texts; starts and ends in bytes."""
    start, end = spans(LETTER[data], offsets)
    return hash_spans(lower_letters(data), start, end), np.searchsorted(start, offsets), start, end


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words."""
    total = h[: len(h) - n + 1] * _COEF[0]
    for j in range(1, n):
        total += h[j : len(h) - n + 1 + j] * _COEF[j]
    return mix(total + np.uint64(n))


def shingle_rows(h: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of all texts, repeats kept, and the text of each, in order.

    A text of fewer than n words has its whole sequence as its one shingle; a
    text without words has none.
    """
    size = np.diff(bounds)
    doc = np.repeat(np.arange(len(size)), size)
    inside = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
    hashes, doc = (combine(h, n)[inside], doc[inside]) if len(inside) else (h[:0], doc[:0])
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.concatenate([combine(h[bounds[i] : bounds[i + 1]], int(size[i])) for i in short])
        at = np.searchsorted(doc, short)
        hashes, doc = np.insert(hashes, at, extra), np.insert(doc, at, short)
    return hashes, doc


def shingles(h: np.ndarray, bounds: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles."""
    hashes, doc = shingle_rows(h, bounds, n)
    cut = np.searchsorted(doc, np.arange(len(bounds)))
    return [np.unique(hashes[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
