"""Vectorised word and k-gram hashing over Arrow text batches.

Texts stay as one UTF-8 byte buffer; word edges, word hashes and k-gram hashes
are computed with numpy over the whole buffer, so no Python loop runs per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; bounds the memory of a Python worker.
STEP_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
#: One random 64-bit value for each byte.
EXACT_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
#: The same, but A-Z share the values of a-z.
BYTE_VALUES = EXACT_VALUES[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_class(pattern: str) -> np.ndarray:
    """256 flags: which bytes belong to a word.  ``alnum``: 0-9, letters and
    every non-ASCII byte; ``solid``: all but space and \\t-\\r; ``letter``:
    ASCII letters and every non-ASCII byte."""
    flags = np.zeros(256, bool)
    flags[128:] = True
    if pattern == "solid":
        flags[:] = True
        flags[[32, 9, 10, 11, 12, 13]] = False
    else:
        flags[65:91] = flags[97:123] = True
        if pattern == "alnum":
            flags[48:58] = True
    return flags


ALNUM, SOLID, LETTER = (byte_class(x) for x in ("alnum", "solid", "letter"))


_of_words: np.ndarray | None = None


def _points_of_words() -> np.ndarray:
    """A flag for each code point: Unicode's letters and the marks that go with them."""
    global _of_words
    if _of_words is None:
        _of_words = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)
    return _of_words


def letters(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes of letters and marks, by Unicode's categories."""
    inside = LETTER[data] & (data < 128)
    at = np.flatnonzero(data >= 0xC2)
    if not len(at):
        return inside
    lead = data[at].astype(np.int64)
    size = np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))
    point = lead & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    behind = np.append(data, np.zeros(4, np.uint8))
    for k in (1, 2, 3):
        point = np.where(size > k, point << 6 | (behind[at + k] & 0x3F), point)
    found = _points_of_words()[np.minimum(point, 0x10FFFF)]
    for k in range(4):
        whole = at[found & (size > k)] + k
        inside[whole[whole < len(data)]] = True
    return inside


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept up to the usual step size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size == STEP_BYTES + 1:
            _powers[base] = have
    return have[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer one stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


class Words:
    """Word spans of a run of texts: starts, ends, and ``at``, the index of the
    first word of each text (one more entry than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, flags: np.ndarray, inside: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        inside = flags[data] if inside is None else inside
        n = len(data)
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        before[offsets] = False
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        after[offsets] = False
        self.starts = np.flatnonzero(inside & ~before[:n])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.at = np.searchsorted(self.starts, offsets)

    def hashes(self, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
        """Hash of each word; ``values`` are those of the bytes."""
        n = len(self.data)
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[self.data] * powers(_BASE, n), out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * powers(_INVERSE, n)[self.starts])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def kgrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; the last k-1 positions are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total *= np.uint64(0xD6E8FEB86659FD93)
        total += hashes[j : j + n]
    return mix(total)


def doc_steps(column: pa.Array, flags: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    data, offsets = flat(column)
    for i, j in steps(offsets):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], flags)


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
