"""64-bit hashes of all words of a text at once.

Words are runs of bytes other than the six ASCII white-space characters. A word's
hash is the sum of a number for each byte and place in the word, from a table of random
numbers for 64 places times one for each 64, taken from running sums over the text, and
mixed at the end. No structure of a word, such as a repeated pattern, meets another in it.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes that are hashed together; a longer word is hashed whole.
SEGMENT = 1 << 20


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective 64-bit mix."""
    x = x + np.uint64(seed * _BASE % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: By place in 64 and byte; the 64s of a longer word have odd factors of their own.
PLACES = 64
_OF_PLACE = mixed(np.arange(PLACES * 256, dtype=np.uint64), 23)
_FACTORS = np.ones(1, np.uint64)


def _factors(n: int) -> np.ndarray:
    global _FACTORS
    if len(_FACTORS) < n:
        _FACTORS = mixed(np.arange(1 << (n - 1).bit_length(), dtype=np.uint64), 31) | np.uint64(1)
        _FACTORS[0] = 1
    return _FACTORS


def _hashes(b: np.ndarray) -> np.ndarray:
    space = np.ones(len(b) + 2, bool)
    space[1:-1] = _SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    inside = np.flatnonzero(~space[1:-1])
    place = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
    term = _OF_PLACE[(place & (PLACES - 1)) * 256 + b[inside]]
    longest = int(size.max())
    if longest > PLACES:
        term = term * _factors(longest // PLACES + 1)[place // PLACES]
    total = np.add.reduceat(term, np.cumsum(size) - size)
    return mixed(total + size.astype(np.uint64), 29)


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words, in order."""
    if len(data) <= SEGMENT:
        return _hashes(np.frombuffer(data, np.uint8))
    b, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(b):
        end = at + SEGMENT
        while end < len(b) and not _SPACE[b[end]]:
            end += 1
        out.append(_hashes(b[at:end]))
        at = end
    return np.concatenate(out)
