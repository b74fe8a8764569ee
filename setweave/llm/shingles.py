"""Word shingles as 64-bit hashes, and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CACHE_WORDS = 200_000


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; keeps the first CACHE_WORDS words it meets until it is cleared."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, split at \\x20 and \\x09-\\x0D (which is what bytes do)."""
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_set(words: list[bytes], cache: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the WORDS-word shingles; of fewer words, one hash of them all; of none, nothing."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, n)
    k = min(n, WORDS)
    out = np.full(n - k + 1, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * MULTIPLIER + h[i : i + len(out)]
        return np.unique(mix(out))


def shingle_sets(words: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The sets of many word lists at once: (hashes, owner), sorted by owner, then hash; owner is the list's place."""
    n = np.array([len(w) for w in words], np.int64)
    ids = np.fromiter(map(cache.__getitem__, (x for w in words for x in w)), np.uint64, int(n.sum()))
    start = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    with np.errstate(over="ignore"):
        for k in range(1, WORDS + 1):
            own = np.flatnonzero(n == k) if k < WORDS else None
            if k < WORDS:
                at, who = start[own], own
            else:
                at = np.flatnonzero(np.arange(len(ids)) - start[owner] <= n[owner] - WORDS)
                who = owner[at]
            if len(at):
                h = np.full(len(at), np.uint64(k))
                for i in range(k):
                    h = h * MULTIPLIER + ids[at + i]
                hashes.append(mix(h))
                owners.append(who)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[first], o[first]


class Minima:
    """Minima of universal hashes a * x + b (mod 2**64, a odd; the upper half counts).

    The first ``bands * rows`` of them make band keys; all of them, with ``extra`` more, the signature.
    """

    def __init__(self, bands: int, rows: int, extra: int = 0, seed: int = 1):
        g = np.random.default_rng(seed)
        self.bands, self.rows, self.size = bands, rows, bands * rows + extra
        self.a = g.integers(0, 2**63, self.size, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = g.integers(0, 2**63, self.size, np.uint64)

    def __call__(self, hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(set, hash function): minima of the sets that begin at ``start``."""
        out = np.empty((self.size, len(start)), np.uint32)
        for k in range(self.size):
            x = hashes * self.a[k]
            x += self.b[k]
            out[k] = np.minimum.reduceat(x, start) >> np.uint64(32)
        return out.T

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """(set, band): 64-bit keys, different for equal minima in different bands."""
        m = minima[:, : self.bands * self.rows].reshape(-1, self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), m.shape[:2])
        with np.errstate(over="ignore"):
            for i in range(self.rows):
                key = key * MULTIPLIER + m[:, :, i]
            return mix(key).view(np.int64)
