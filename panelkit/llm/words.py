"""Words of texts and 64-bit fingerprints of words and of word sequences, in numpy.

Words are maximal runs of bytes other than space and ``\\t\\n\\v\\f\\r``; in UTF-8
no other character holds these bytes, so ``bytes.split()`` gives the same words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_MUL1, _MUL2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_STEP = U(0xD6E8FEB86659FD93)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_STEP_INVERSE = U(pow(int(_STEP), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A long text is hashed in pieces of about this many bytes, cut at white space.
PIECE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the result depends on all bits of ``x``."""
    x = (x ^ (x >> U(30))) * _MUL1
    x = (x ^ (x >> U(27))) * _MUL2
    return x ^ (x >> U(31))


_BYTES = mixed(np.arange(1, 257, dtype=U) * _STEP)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]


class _Powers:
    """Powers of an odd number modulo 2^64, longer as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.known = base, np.ones(1, U)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            self.known = np.cumprod(np.r_[np.ones(1, U), np.full(max(n, 1024) * 5 // 4, self.base, U)])
        return self.known[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)
_STEPS_UP, _STEPS_DOWN = _Powers(_STEP), _Powers(_STEP_INVERSE)


class _Weights:
    """Odd numbers without a law, one for each place in a word, longer as needed."""

    def __init__(self) -> None:
        self.known = np.empty(0, U)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            self.known = mixed(mixed(np.arange(1, max(n, 1024) * 5 // 4, dtype=U) * _BASE) ^ _STEP) | U(1)
        return self.known[:n]


_PLACES = _Weights()


def _hashes(data: bytes, table: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(np.r_[False, inside, False].view(np.int8))
    sizes = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    if not len(sizes):
        return np.empty(0, U)
    # powers of one number will not do: modulo 2^64 they make Thue-Morse words and their complements equal
    last = np.cumsum(sizes)
    first = last - sizes
    places = np.arange(last[-1]) - np.repeat(first, sizes)
    sums = np.r_[np.zeros(1, U), np.cumsum(table[raw[inside]] * _PLACES.upto(int(sizes.max()))[places])]
    return mixed(sums[last] - sums[first] + sizes.astype(U) * _STEP)


def word_hashes(data: bytes, lower: bool = False) -> np.ndarray:
    """One fingerprint for each word of UTF-8 ``data``; ``lower``: A-Z count as a-z."""
    table = _LOWER if lower else _BYTES
    if len(data) <= 2 * PIECE:
        return _hashes(data, table)
    found, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        found.append(_hashes(data[at:end], table))
        at = end
    return np.concatenate(found)


def texts_hashes(texts: list[bytes], lower: bool = False) -> list[np.ndarray]:
    """``word_hashes`` of each text, with one pass over short texts joined together."""
    if sum(map(len, texts)) > 4 * PIECE:
        return [word_hashes(t, lower) for t in texts]
    counts = np.array([len(t.split()) for t in texts], np.int64)
    return np.split(_hashes(b" ".join(texts), _LOWER if lower else _BYTES), np.cumsum(counts)[:-1]) if texts else []


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U)
    total = np.zeros(n, U)
    for j, step in enumerate(_STEPS_UP.upto(k)):
        total += words[j : j + n] * step
    return mixed(total + U(k))


def spans(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Fingerprints of the word sequences ``words[first:last]``, independent of their place."""
    if not len(first):
        return np.empty(0, U)
    # another mix than that of grams(), so that the two are independent
    sums = np.r_[np.zeros(1, U), np.cumsum(mixed(words ^ _MUL2) * _STEPS_UP.upto(len(words)))]
    own = (sums[last] - sums[first]) * _STEPS_DOWN.upto(int(first.max()) + 1)[first]
    return mixed(own + (last - first).astype(U) * _BASE)


def sequence(words: np.ndarray) -> np.uint64:
    """One fingerprint of a whole word sequence."""
    return spans(words, np.array([0]), np.array([len(words)]))[0]


def bytes_hashes(pieces: list[bytes]) -> np.ndarray:
    """One fingerprint for each byte string, whatever bytes it holds."""
    if not pieces:
        return np.empty(0, U)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    last = np.cumsum(sizes)
    first = last - sizes
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    sums = np.r_[np.zeros(1, U), np.cumsum(_BYTES[raw] * _UP.upto(len(raw)))]
    own = (sums[last] - sums[first]) * _DOWN.upto(int(first[-1]) + 1)[first]
    return mixed(own + sizes.astype(U) * _STEP)
