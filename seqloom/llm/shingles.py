"""Word shingles as sorted 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np

from seqloom.llm import common

SIZE = 5
#: Signature: CHUNKS chunks of CHUNK symbols of 16 bits. Two signatures at no more than RADIUS unequal symbols have a chunk
#: with one unequal symbol at most (pigeonhole: 2 in each of the CHUNKS chunks would make RADIUS + 1).
CHUNKS, CHUNK = 11, 6
SYMBOLS, RADIUS = CHUNKS * CHUNK, 2 * CHUNKS - 1
_RNG = np.random.Generator(np.random.PCG64(20240229))
_PLACE = _RNG.integers(0, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CACHE_WORDS = 120_000


class _Words(dict):
    """Hashes of words seen by this worker; emptied when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


_words = _Words()


def forget() -> None:
    _words.clear()


@lru_cache
def _factors(symbols: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240301)).integers(0, 2**63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def of(text: str | None) -> np.ndarray:
    """The distinct shingles, in order; a text of 1 to 4 words has one, its whole sequence; without words there is none."""
    words = common.tokens(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(words) < SIZE:
        total = np.full(1, len(words), dtype=np.uint64)
        for k in range(len(words)):
            total = total + h[k : k + 1] * _PLACE[k]
        return mix(mix(total))
    n = len(h) - SIZE + 1
    total = h[:n] * _PLACE[0]
    for k in range(1, SIZE):
        total = total + h[k : k + n] * _PLACE[k]
    return np.unique(mix(total))


def signature(shingles: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """The first `symbols` symbols of a document's endless signature."""
    factor = _factors(symbols)
    least = np.full(symbols, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[k : k + 1024, None] * factor).min(axis=0), out=least)
    return mix(least).astype(np.uint16)


def digest(shingles: np.ndarray) -> bytes:
    return blake2b(shingles.tobytes(), digest_size=16).digest()
