"""Word shingles as 64-bit hashes, and MinHash signatures of them, in NumPy."""

from __future__ import annotations

import numpy as np
import xxhash

_U64 = np.uint64


class WordHash(dict):
    """Word (bytes) to a signed 64-bit hash, kept for reuse; emptied when it holds about ``most`` bytes, so memory is bounded."""

    def __init__(self, most: int = 24 << 20):
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 160  # an entry with its key's and value's objects
        if self.held > self.most:
            self.clear()
            self.held = 0
        value = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, element by element."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text: ASCII letters lowered, split at ASCII white space only."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | _U64(1)


def shingle_set(text: str | None, width: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; of all words as one where there are fewer."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.int64, n).view(np.uint64)
    take = min(width, n)
    out = np.zeros(n - take + 1, np.uint64)
    for j, k in enumerate(_multipliers(take, 11)):
        out += h[j : n - take + 1 + j] * k
    return np.unique(mix(out + _U64(take)))


class MinHasher:
    """``size`` minima of affine permutations of 32-bit shingle hashes; of each, the low 16 bits are kept,
    which tell the shingle that gave the minimum (the high bits only tell how long the text is)."""

    def __init__(self, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.size = size
        self.flip = rng.integers(0, 1 << 32, (size, 1), dtype=np.uint32)
        self.factor = rng.integers(0, 1 << 32, (size, 1), dtype=np.uint32) | np.uint32(1)

    def __call__(self, hashes: np.ndarray) -> bytes:
        x = (hashes >> _U64(32)).astype(np.uint32)
        least = np.full(self.size, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 1024):
            block = (x[None, i : i + 1024] ^ self.flip) * self.factor
            np.minimum(least, block.min(axis=1), out=least)
        return least.astype("<u2").tobytes() if len(x) else b""
