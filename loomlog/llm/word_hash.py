"""64-bit hashes of words and of runs of words, vectorised.

Words are runs of bytes between ASCII white space, which is what ``bytes.split()`` gives. A run of
words hashes to the polynomial of its words' hashes modulo 2**64; prefix sums and powers of an odd
base (and of its inverse) give the hash of any run in O(1). Runs are short (up to a few hundred
words) and word hashes random, so that equal hashes stand for equal runs.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SHARED: list[WordHasher] = []


def shared_hasher() -> WordHasher:
    """One table of words for each Python worker, whatever runs in it."""
    if not _SHARED:
        _SHARED.append(WordHasher())
    return _SHARED[0]


class WordHasher:
    """Hashes of words, with a bounded table of those met before."""

    def __init__(self, max_words: int = 150_000):
        self.max_words = max_words
        self.known: dict[bytes, bytes] = {}
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _new(self, word: bytes) -> bytes:
        out = xxhash.xxh64_intdigest(word, 0x5EED).to_bytes(8, "little")
        if len(self.known) < self.max_words and len(word) <= 32:
            self.known[word] = out
        return out

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            packed = b"".join([known[w] for w in words])
        except KeyError:
            get, new = known.get, self._new
            packed = b"".join([get(w) or new(w) for w in words])
        return np.frombuffer(packed, "<u8")

    def _grow(self, n: int) -> None:
        if len(self.powers) <= n:
            n = max(2 * len(self.powers), n + 1)
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        """Prefix sums for :meth:`runs`."""
        self._grow(len(hashes))
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.powers[: len(hashes)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of the words from each start up to, not including, each end."""
        return mix((prefix[ends] - prefix[starts]) * self.inverses[starts])
