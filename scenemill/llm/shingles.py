"""Hashed word n-grams of whole texts, and their MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word (runs without ASCII white space) and where each text's begin."""
    encoded = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join([*encoded, b""]), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(e) + 1 for e in encoded])])
    inside = np.flatnonzero((data != 32) & ((data < 9) | (data > 13)))
    if not len(inside):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], np.diff(inside) > 1]))
    lengths = np.diff(np.concatenate([begins, [len(inside)]]))
    places = np.arange(len(inside)) - np.repeat(begins, lengths)
    powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(lengths.max(), _BASE))])
    values = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[places], begins)
    return mixed(values + lengths.astype(np.uint64) * _ODD), np.searchsorted(inside[begins], first)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The distinct n-grams of each text, sorted. A text of fewer words is one n-gram; one without words has none."""
    hashes, first = word_hashes(texts)
    factors = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(hashes) - words + 1)
    grams = mixed(sum((hashes[i : i + n] * factors[i] for i in range(words)), np.zeros(n, np.uint64)))
    found = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            found.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            found.append(mixed((hashes[a:b] * factors[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            found.append(np.empty(0, np.uint64))
    return found


def choose_bands(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """Bands and rows a band: a pair at the threshold meets in a band with the target recall.

    Of the choices within ``most_hashes``, the one with most rows a band lets the fewest other pairs meet.
    """
    best = None
    for rows in range(1, most_hashes + 1):
        meet = threshold**rows
        bands = 1 if meet >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-meet)))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach the recall")
    return best


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**32, bands * rows, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, bands * rows, np.uint32)[:, None]

    def minima(self, grams: np.ndarray, block: int = 1024) -> np.ndarray:
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        low = (grams >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(low), block):
            np.minimum(least, (self.a * low[i : i + block] + self.b).min(axis=1), out=least)
        return least

    def band_hashes(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit key a band, in which the band's number takes part."""
        keys = np.arange(1, self.bands + 1, dtype=np.uint64) * _ODD
        for column in minima.reshape(self.bands, self.rows).T.astype(np.uint64):
            keys = mixed(keys ^ (column + _BASE))
        return keys.view(np.int64)

    @staticmethod
    def sketch(minima: np.ndarray) -> bytes:
        """A byte of each minimum: equal bytes estimate the similarity."""
        return (minima & np.uint32(255)).astype(np.uint8).tobytes()
