"""Word and shingle hashes, vectorised over numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64


def salt(n: int) -> np.uint64:
    """The n-th constant of a Weyl sequence."""
    return U(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hash_all(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows; of the whole sequence if it has fewer words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, k)
    out = mix(hashes[: n - width + 1] + salt(width))
    for j in range(1, width):
        out = mix(out * U(0xD6E8FEB86659FD93) + hashes[j : n - width + 1 + j])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles(hash_all(words_of(text)), k))
