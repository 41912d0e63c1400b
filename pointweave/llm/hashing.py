"""64-bit hashes of words and shingles, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

#: Words whose hashes a worker keeps, and the length up to which it keeps one.
MOST_KEPT, LONGEST_KEPT = 150_000, 64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit changes about half of the output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1 modulo 2**64."""
    out = np.ones(1, np.uint64)
    step = base
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * step])
            step = step * step
    return out[:n]


class _Words(dict):
    """Hashes of words, filled as they are met; words too long to recur are not kept."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[word] = h
        return h


_WORDS = _Words()


def forget() -> None:
    """Give up the words kept."""
    _WORDS.clear()


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its words, which are runs without ASCII white space.

    A word's hash is the first 8 bytes of its BLAKE2b digest, so no structure
    of the words makes different ones collide.
    """
    out = []
    for t in texts:
        own = t.split()
        out.append(np.fromiter(map(_WORDS.__getitem__, own), np.uint64, len(own)))
    return out


def shingles(own: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``size`` words; fewer words count as one run, none as none."""
    n = len(own)
    if not n:
        return own
    k = min(size, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out + own[i : n - k + 1 + i])
    return np.unique(out)
