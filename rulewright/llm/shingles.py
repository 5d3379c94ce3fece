"""Hashed word shingles of whole texts, vectorised over a batch.

A word's hash is its 128-bit BLAKE2b digest, so no two words have a structural collision; each of the digest's two 64-bit
lanes gives one lane of the shingles. Sets are compared by the first lane: two different shingles agree in it with a
probability of 2^-64. Whole sets are told apart by a 128-bit digest over both lanes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20_240_601))
#: Odd multipliers of each place of a shingle, in each lane.
_PLACE = _RNG.integers(1, 2**63 - 1, (64, 2), np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _RNG.integers(1, 2**63 - 1, 2, np.uint64)
_LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
#: Most words that a worker remembers the digest of, and the most bytes of such a word.
MOST_WORDS, LONGEST = 1 << 17, 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finisher of a public hash, splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Digests(dict):
    """Word -> its 16-byte digest, for the words seen last."""

    def __missing__(self, word: bytes) -> bytes:
        digest = blake2b(word, digest_size=16).digest()
        if len(word) <= LONGEST:
            if len(self) >= MOST_WORDS:
                self.clear()
            self[word] = digest
        return digest


_DIGESTS = _Digests()


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, list[int]]:
    """((words, 2) 64-bit lanes of the words of all texts in order, number of words of each text).

    Words are runs without ASCII white space, which is what ``bytes.split`` gives; ``lower`` lower-cases A-Z.
    """
    words: list[bytes] = []
    counts = []
    for text in texts:
        found = (text.translate(_LOWER) if lower else text).split()
        counts.append(len(found))
        words += found
    return np.frombuffer(b"".join(map(_DIGESTS.__getitem__, words)), "<u8").reshape(-1, 2), counts


def _lanes(words: np.ndarray, k: int, lane: int) -> np.ndarray:
    """One lane of every k-word shingle that starts in ``words``, texts' ends ignored."""
    width = max(len(words) - k + 1, 0)
    out = np.zeros(width, np.uint64)
    for j in range(k if width else 0):
        out += words[j : j + width, lane] * _PLACE[j, lane]
    return mix(out)


def shingle_lanes(texts: list[bytes], k: int, lower: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted distinct values of both lanes of its k-word shingles; fewer words: all of them as one."""
    words, counts = word_hashes(texts, lower)
    lanes = [_lanes(words, k, i) for i in (0, 1)]
    out, base = [], 0
    for n in counts:
        if n >= k:
            out.append(tuple(np.unique(x[base : base + n - k + 1]) for x in lanes))
        elif n:
            short = (words[base : base + n] * _PLACE[:n]).sum(axis=0, dtype=np.uint64)
            out.append(tuple(mix((short ^ _SHORT) + np.uint64(n))[i : i + 1] for i in (0, 1)))
        else:
            out.append((np.zeros(0, np.uint64),) * 2)
        base += n
    return out


def shingle_sets(texts: list[bytes], k: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text."""
    return [first for first, _ in shingle_lanes(texts, k, lower)]


def set_digest(lanes: tuple[np.ndarray, np.ndarray]) -> bytes:
    """16 bytes that tell a whole set of shingles."""
    return blake2b(lanes[0].tobytes() + lanes[1].tobytes(), digest_size=16).digest()
