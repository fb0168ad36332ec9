"""Word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

WORDS = 5
STRETCH = 1 << 20  # bytes of one text hashed together
KEPT_WORDS = 200_000  # whose digests a Python worker remembers
KEY = b"shingles of words"
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
BREAK = re.compile(rb"[\x20\x09-\x0D]")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, for texts of up to ``size`` bytes."""
    both = []
    for base in (BASE, INVERSE):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


class WordHashes(dict):
    """64-bit digests of words, remembered while they are few enough."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = digest = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=KEY).digest(), "little")
        return digest


_hashes = WordHashes()


def forget_words() -> None:
    """Give the memory of the digests back; workers live on after a step."""
    _hashes.clear()


def stretches(raw: bytes) -> Iterator[bytes]:
    """``raw`` in parts that end at white space."""
    start = 0
    while len(raw) - start > STRETCH:
        cut = BREAK.search(raw, start + STRETCH)
        if cut is None:
            break
        yield raw[start : cut.start()]
        start = cut.start()
    yield raw[start:]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit digest of every word (run of anything but ASCII white space), A-Z lower-cased."""
    # Bytes split at just the white space that ends words here, and lower() changes A-Z alone.
    found = [np.array([*map(_hashes.__getitem__, part.lower().split())], dtype=np.uint64) for part in stretches(raw)]
    return np.concatenate(found)


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; with fewer words, of the whole sequence as one."""
    hashes = word_hashes(text.encode("utf-8", "surrogatepass"))
    if not len(hashes):
        return hashes
    width = min(words, len(hashes))
    total = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = total * np.uint64(BASE) + hashes[i : len(hashes) - width + 1 + i]
    return np.unique(mixed(total + np.uint64(width)))
