"""Words of whole texts as 64-bit hashes, computed with numpy over a block of bytes.

A word's hash is a polynomial in a random odd base over random byte values
(modulo 2**64), taken from prefix sums, then mixed.  Seeds are fixed, so every
task computes the same hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(2**61, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_CODES = np.arange(256)
#: A-Z to a-z, all other bytes as they are.
FOLD = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)
#: Bytes of a word between white space: anything but space and 09-0D.
NOT_SPACE = ~((_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D)))
#: Bytes of an alphanumeric word: 0-9, letters, and all of a character beyond 7F.
ALNUM = (
    ((_CODES >= 0x30) & (_CODES <= 0x39))
    | ((_CODES >= 0x41) & (_CODES <= 0x5A))
    | ((_CODES >= 0x61) & (_CODES <= 0x7A))
    | (_CODES >= 0x80)
)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of data[starts[i]:ends[i]] for all i."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    terms = sums[1:]  # in place: a block's prefix sums are the largest that a task holds for it
    np.take(_BYTE, data, out=terms, mode="clip")
    terms *= power[: len(data)]
    np.cumsum(terms, out=terms)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of a block: byte ranges, hashes, and ``first[i]:first[i + 1]`` for document i."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of bytes in ``inside`` within each document, A-Z folded."""
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(none, none, np.empty(0, np.uint64), np.zeros(len(offsets), np.int64))
    member = inside[data]
    opens, closes = member.copy(), member.copy()
    opens[1:] &= ~member[:-1]
    closes[:-1] &= ~member[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    opens[cuts] = member[cuts]
    closes[cuts - 1] = member[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = segment_hashes(FOLD[data], starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of ``size`` words for each document; a document
    of fewer words, but not none, has its whole sequence as its one shingle."""
    h = words.hashes
    full = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        full += h[k : k + len(full)] * _STEP[k]
    full = mix(full)
    sets = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            sets.append(np.unique(full[a : b - size + 1]))
        elif n:
            sets.append(mix((h[a:b] * _STEP[:n]).sum(dtype=np.uint64, keepdims=True) + _STEP[32 + n : 33 + n]))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
