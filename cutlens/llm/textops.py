"""Word and shingle hashing shared by the text operators; numpy inside Arrow batches."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash

#: Words of a cache; beyond it the cache starts anew, so a worker's memory stays bounded.
CACHE_WORDS = 300_000
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hash of each word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``lower`` lower-cases A-Z only."""
    if not text:
        return []
    raw = text.encode()
    return (raw.lower() if lower else raw).split()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble, so that low and high bits are both usable."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


@functools.cache
def _powers(variant: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``2 ** bits`` powers of a multiplier and of its inverse."""
    base = int(_MULTIPLIERS[variant])
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full((1 << bits) - 1, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))


def runs(hashes: np.ndarray, size: int, variant: int = 0) -> np.ndarray:
    """Hash of every ``size`` consecutive words, in order; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = mixed(hashes + np.uint64(variant))
    if size <= 8:
        total = base[:n].copy()
        for j in range(1, size):
            total *= _MULTIPLIERS[variant]
            total += base[j : j + n]
        return mixed(total)
    # the same sums as differences of one running sum
    power, inverse = _powers(variant, max(12, (len(hashes) - 1).bit_length()))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(base * inverse[: len(hashes)], out=sums[1:])
    return mixed((sums[size:] - sums[:n]) * power[size - 1 : size - 1 + n])


def shingle_set(words: list[bytes], size: int, cache: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``size`` count as one shingle, none as none."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs(cache.of(words), min(size, len(words))))


def texts_of(batch: pa.RecordBatch | pa.Table, column: str) -> list[str | None]:
    return batch.column(column).to_pylist()


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
