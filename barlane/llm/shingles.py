"""Words and word shingles of whole texts: A-Z in lower case, words without space, tab, line feed, vertical tab, form
feed and carriage return."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def words(text: str) -> list[bytes]:
    """The words of a text, as UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Hasher:
    """64-bit hashes of words and of runs of words. Words of a worker are hashed once while the cache has room."""

    def __init__(self, most: int = 300_000) -> None:
        import xxhash

        self.digest, self.most, self.cache = xxhash.xxh3_64_intdigest, most, {}

    def words(self, listed: list[list[bytes]]) -> list[np.ndarray]:
        """Hashes of the words of each list."""
        cache = self.cache
        new = set().union(*listed).difference(cache) if listed else ()
        room = self.most - len(cache)
        digest = self.digest
        cache.update((w, digest(w)) for w in new)
        get = cache.__getitem__
        out = [np.fromiter(map(get, ws), np.uint64, len(ws)) for ws in listed]
        if room < len(new):
            for w in new:
                del cache[w]
        return out


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` neighbouring words, from the words' hashes."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = h[:n] + _U(size)
    for k in range(1, size):
        out = (out ^ (out >> _U(31))) * _U(0x9E3779B97F4A7C15) + h[k : k + n]
    out = (out ^ (out >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    return out ^ (out >> _U(31))


def rare_first(ws: list[bytes], h: np.ndarray, size: int) -> np.ndarray:
    """Ascending distinct shingles of a text as 64-bit numbers whose order puts those likely to be rare first: the
    highest 6 bits fall with the bytes of the shingle's words, since long words are rare, the others are its hash."""
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(size, len(h))
    upto = np.zeros(len(ws) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)), out=upto[1:])
    length = np.minimum(upto[k:] - upto[:-k], 63).astype(np.uint64)
    return np.unique((_U(63) - length) << _U(58) | runs(h, k) >> _U(6))


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """Ascending distinct shingle hashes; with fewer words than `size` the whole sequence is one, without words none."""
    return np.unique(runs(h, min(size, len(h)))) if len(h) else np.empty(0, np.uint64)
