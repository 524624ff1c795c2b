"""Vectorised words and word hashes over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a list of byte strings: spans in ``data``, the text each is in, and 64-bit hashes."""

    def __init__(self, raws: list[bytes], is_word: np.ndarray, hashes: bool = True) -> None:
        """is_word: 256 booleans; byte 32 must not be one, it parts the texts."""
        self.data = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
        self.lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        self.offsets = np.cumsum(self.lengths + 1) - self.lengths - 1
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = is_word[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.text = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.text, minlength=len(raws))
        if hashes:
            n = len(self.data)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(FACTOR, n), out=total[1:])
            back = powers(INVERSE, n)
            self.hashes = mix((total[self.ends] - total[self.starts]) * back[self.starts] + (self.ends - self.starts).astype(np.uint64))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 booleans, true within the ranges (both ends included)."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Everything but the white space [\x20\x09-\x0D]; and digits, letters a-z and all non-ASCII bytes.
NOT_SPACE = ~byte_class((32, 32), (9, 13))
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
