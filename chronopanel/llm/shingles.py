"""Word shingles as hashed sets and their MinHash, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_U = np.uint64
_A, _B, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> _U(33))
    x = x * _M1
    x ^= x >> _U(33)
    x *= _M2
    x ^= x >> _U(33)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), _U, len(words))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of ``n`` words, in order; fewer words than ``n`` make one shingle."""
    size = len(hashes)
    if size == 0:
        return hashes
    width = min(n, size)
    out = np.full(size - width + 1, width, _U) * _B
    for i in range(width):
        out = mix(out * _A + hashes[i : size - width + 1 + i])
    return out


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words; ``bytes.split`` parts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingles of a text."""
    return distinct(shingle_hashes(word_hashes(words_of(text)), n))


class MinHash:
    """``k`` minima of random linear maps of a set of 64-bit numbers."""

    def __init__(self, k: int, seed: int):
        draw = np.random.default_rng(seed)
        self.k = k
        self.a = draw.integers(0, 1 << 63, k, dtype=_U) * _U(2) + _U(1)
        self.b = draw.integers(0, 1 << 63, k, dtype=_U)

    def values(self, x: np.ndarray) -> np.ndarray:
        """(k, len(x)) images of ``x``."""
        return np.multiply.outer(self.a, x) + self.b[:, None]

    def minima(self, x: np.ndarray, cells: int = 1 << 16) -> np.ndarray:
        """Mixed minima over a non-empty set, block by block so that buffers stay in cache.

        The maps are of 32 bits, on the high half of the numbers: those are about twice as fast.
        """
        x = (x >> _U(32)).astype(np.uint32)
        a, b = (c.astype(np.uint32)[:, None] for c in (self.a, self.b))
        width = min(len(x), cells // 4)
        rows = min(self.k, cells // width)
        least, images = np.full(self.k, ~np.uint32(0)), np.empty(rows * width, np.uint32)
        for at in range(0, len(x), width):
            part = x[at : at + width]
            for i in range(0, self.k, rows):
                n = min(rows, self.k - i)
                image = images[: n * len(part)].reshape(n, len(part))
                np.multiply(a[i : i + n], part, out=image)
                image += b[i : i + n]
                np.minimum(least[i : i + n], image.min(axis=1), out=least[i : i + n])
        return mix(least.astype(_U))


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` minima, different bands apart."""
    bands = minima[: len(minima) // rows * rows].reshape(-1, rows)
    key = np.arange(len(bands), dtype=_U) * _B + _U(1)
    for i in range(rows):
        key = mix(key * _A + bands[:, i])
    return key
