"""Word, line and n-gram hashing over Arrow text columns with numpy.

A text column arrives as one contiguous UTF-8 buffer with offsets. All helpers work on
such a buffer at once, so no Python code runs per word. A *word* is a maximal run of
bytes outside ``0x20`` and ``0x09-0x0D``; both sets are ASCII, so byte runs are also
code-point runs. All hashes have 64 bits; equal strings have equal hashes on every executor.

Spans of any length (words, lines) are hashed in chained steps of eight bytes, long ones by
BLAKE2. Runs of words are compared by polynomials modulo the prime 2**61 - 1. Only windows of
a fixed, small number of bytes are hashed by polynomials modulo 2**64, on which long
texts of a known pattern (Thue-Morse) collide whatever the base.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)
_pow: dict[int, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: For each byte a random-looking odd number; sums of its multiples make the hashes.
_BYTE = np.array([((b + 1) * 0xD6E8FEB86659FD93 ^ (b * b + 7) * 0xA0761D6478BD642F) & _MASK for b in range(256)], np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _pow[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of pieces of at most ``limit`` bytes, or one long text.

    A null text counts as empty. Bounds the memory that a kernel needs, whatever the
    size of the Arrow batch.
    """
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if column.null_count:
        texts = [x.as_buffer() if x.is_valid else b"" for x in column]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
    first, n = 0, len(column)
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Array ``p`` of ``len(data) + 1``; with it :func:`window_hash` hashes short windows of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, max(1, len(data)))[: len(data)], dtype=np.uint64, out=out[1:])
    return out


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(prefix)
    return mix((prefix[end] - prefix[start]) * _powers(_INV, n)[start] + (end - start).astype(np.uint64))


#: Spans of more bytes are hashed one by one.
LONG_SPAN = 2048


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes."""
    size = (end - start).astype(np.int64)
    h = mix(size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    some, at = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(some):
        v = eight[start[some] + at]
        rest = size[some] - at
        part = rest < 8
        v[part] &= (np.uint64(1) << (rest[part] * 8).astype(np.uint64)) - np.uint64(1)
        h[some] = mix((h[some] ^ v) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(at + 1))
        at += 8
        some = some[rest > 8]
    for i in np.flatnonzero(size > LONG_SPAN):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def all_hashes(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of each span of ``k`` bytes."""
    n = len(prefix) - k
    return mix((prefix[k:] - prefix[:n]) * _powers(_INV, n + k)[:n] + np.uint64(k))


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one more entry than texts)."""
    inside = ~SPACE[data] if word_byte is None else word_byte[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    start = np.flatnonzero(inside & (~before | border[:-1]))
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    return start, end, np.searchsorted(start, offsets).astype(np.int64)


_PRIME = np.uint64((1 << 61) - 1)
_ROOT = 0x1F3A5B7C9D2E4F61 % ((1 << 61) - 1)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it."""
    low = np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> np.uint64(31), a & low, b >> np.uint64(31), b & low
    middle = a0 * b1 + a1 * b0
    return _reduce(a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0)


def _prime_powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(-base)
    if have is None or len(have) < n:
        have, step = np.ones(1, np.uint64), base
        while len(have) < max(n, 1 << 12):
            have = np.concatenate([have, times(have, np.uint64(step))])
            step = step * step % int(_PRIME)
        _pow[-base] = have
    return have[:n]


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """Array of ``len(words) + 1``; with it :func:`sequence_span` hashes any run of words."""
    term = times(_reduce(mix(words)), _prime_powers(_ROOT, max(1, len(words)))[: len(words)])
    out = np.zeros(len(words) + 1, np.uint64)
    # Halves are added up apart, so no sum leaves 64 bits.
    high, low = np.cumsum(term >> np.uint64(31), dtype=np.uint64), np.cumsum(term & np.uint64((1 << 31) - 1), dtype=np.uint64)
    out[1:] = _reduce(times(_reduce(high), np.uint64(1 << 31)) + _reduce(low))
    return out


def sequence_span(prefix: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    inverse = _prime_powers(pow(_ROOT, -1, int(_PRIME)), len(prefix))
    return times(_reduce(prefix[start + size] + _PRIME - prefix[start]), inverse[start])


def ngram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; the last ``k - 1`` entries are left out."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h + words[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return mix(h)


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles and their text's row; a text of 1 to ``k - 1`` words is one shingle."""
    h, rows = ngram_hash(words, k), np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = rows[: len(h)] == rows[k - 1 :][: len(h)]
    out, row = h[ok], rows[: len(h)][ok]
    count = np.diff(first)
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        whole = words[first[short][:, None] + np.arange(n)].reshape(-1)
        out = np.concatenate([out, ngram_hash(whole, n)[::n] ^ np.uint64(n)])
        row = np.concatenate([row, short])
    return out, row


def cover(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Boolean array of the positions that lie in any ``[start, end)``."""
    depth = np.bincount(start, minlength=size + 1)[: size + 1] - np.bincount(end, minlength=size + 1)[: size + 1]
    return np.cumsum(depth)[:size] > 0
