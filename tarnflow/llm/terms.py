"""Hashes of the words of many texts at once, on arrays of code points."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by a line end, as code points; and the index of each one's start."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return points, np.cumsum(lens) - lens


_LETTER: np.ndarray | None = None


def is_letter(points: np.ndarray) -> np.ndarray:
    """Whether code points are letters (of any script)."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER[points]


def is_space(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points >= 9) & (points <= 13))


class Words:
    """Maximal runs of ``inside`` code points: start, length, text number and hash of each."""

    def __init__(self, points: np.ndarray, starts: np.ndarray, inside: np.ndarray):
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        if len(inside) and inside[-1]:
            edge = np.append(edge, len(inside))
        self.start, end = edge[0::2], edge[1::2]
        self.length = end - self.start
        self.doc = np.searchsorted(starts, self.start, side="right") - 1
        self._points, self._inside = points, inside
        self._value = None

    def _weighted(self) -> np.ndarray:
        if self._value is None:
            at = np.flatnonzero(self._inside)
            place = at - np.repeat(self.start, self.length)
            powers = np.ones(int(self.length.max()) if len(self.length) else 1, U)
            powers[1:] = U(_BASE)
            powers = np.multiply.accumulate(powers)
            self._value = mix(self._points[at].astype(U) + U(0x51ED27)) * powers[place]
            self._first = np.cumsum(self.length) - self.length
        return self._value

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first ``prefix`` characters (shorter words: of the word)."""
        if not len(self.start):
            return np.zeros(0, U)
        value = self._weighted()
        if prefix is None:
            return mix(np.add.reduceat(value, self._first))
        upto = np.concatenate([[U(0)], np.cumsum(value)])
        return mix(upto[self._first + np.minimum(self.length, prefix)] - upto[self._first])
