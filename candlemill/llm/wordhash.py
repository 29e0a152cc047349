"""Hashes of words and shingles in tasks, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once, unless one text is longer.
SLICE = 1 << 20
#: Odd multipliers of a shingle's words, and of its length.
_TIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_LENGTH = 0xE7037ED1A0B428DB


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: A number for each byte, one for both cases of A-Z, none for white space.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_BYTES[65:91] = _BYTES[97:123]
_BYTES[_SPACES] = 0


def _places(n: int) -> np.ndarray:
    return mix(np.arange(1 << 32, (1 << 32) + n, dtype=np.uint64)) | np.uint64(1)


_FIRST_PLACES = _places(1 << 12)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of each word, the runs of bytes other than white space, lower-cased in A-Z."""
    x = np.frombuffer(data, np.uint8)
    solid = ~_SPACES[x]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    first = np.flatnonzero(begins)
    if not len(first):
        return np.empty(0, np.uint64), first
    at = np.arange(len(x)) - first[np.maximum(np.cumsum(begins) - 1, 0)]
    top = int(at.max()) + 1
    place = _FIRST_PLACES if top <= len(_FIRST_PLACES) else _places(top)
    return mix(np.add.reduceat(_BYTES[x] * place[np.maximum(at, 0)], first)), first


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by their hashes."""
    total = np.full(max(0, len(h) - n + 1), _LENGTH * n % (1 << 64), np.uint64)
    for d in range(n):
        total += h[d : d + len(total)] * np.uint64(_TIMES[d])
    return mix(total)


def slices(texts: list[bytes | None]) -> Iterator[list[bytes]]:
    """Texts in slices of about SLICE bytes; null is empty."""
    part, size = [], 0
    for x in texts:
        part.append(x or b"")
        size += len(part[-1]) + 1
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def words_by_text(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts one after the other, and how many each text has."""
    h, first = word_hashes(b" ".join(texts))
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    return h, np.diff(np.searchsorted(first, ends), prepend=0)


def shingles_by_text(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, one text after the other, and how many each has; fewer words are one shingle, none none."""
    h, size = words_by_text(texts)
    begin = np.cumsum(size) - size
    parts, count = [], np.zeros(len(texts), np.int64)
    of = {k: runs_of(h, k) for k in ({n} | set(size[size < n].tolist())) - {0}}
    for i, (b, s) in enumerate(zip(begin.tolist(), size.tolist())):
        if s:
            own = np.sort(of[min(n, s)][b : b + max(1, s - n + 1)])
            if len(own) > 1:
                own = own[np.r_[True, own[1:] != own[:-1]]]
            parts.append(own)
            count[i] = len(own)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), count
