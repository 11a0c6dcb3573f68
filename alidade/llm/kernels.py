"""Vectorised hashing of words and word shingles over Arrow string batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at once (one longer text is still hashed whole).
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LENGTH = _rng.integers(1, 2**63, 64, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_powers: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def _words(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in data, and for each text [begin, end) the index of its first word, then the total."""
    inside = _IS_WORD[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0], before[1:] = False, inside
    before[begins] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(data) + 1, dtype=bool)
    after[:-1], after[-1] = inside, False
    after[ends] = False
    stops = np.flatnonzero(inside & ~after[1:]) + 1
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    hashes = mixed((sums[stops] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts])
    return hashes, np.searchsorted(starts, np.append(begins, len(data)))


def shingle_sets(texts: pa.Array, k: int, lower: bool = False) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles (uint64).

    Words are runs of bytes other than blank and 09-0D; `lower` folds A-Z. A text with 1 to k - 1 words has one
    shingle, its whole sequence; a null text or one without words has none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.empty(0, np.uint8)
    i, empty = 0, np.empty(0, np.uint64)
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        j = min(j, len(texts))
        data = raw[offsets[i] : offsets[j]]
        if lower:
            data = _LOWER[data]
        if not len(data):
            yield from [empty] * (j - i)
            i = j
            continue
        hashes, first = _words(data, offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i])
        n = max(0, len(hashes) - k + 1)
        grams = np.zeros(n, dtype=np.uint64)
        for d in range(k):
            grams += hashes[d : d + n] * _ODD[d]
        grams = mixed(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mixed((hashes[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True) + _LENGTH[b - a])
            else:
                yield empty
        i = j
