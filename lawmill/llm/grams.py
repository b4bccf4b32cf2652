"""Numpy routines on texts: code points, rolling hashes, and the seeds of windows."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Window positions handled in one go: they take 24 bits beside 40 bits of hash.
CHUNK = 1 << 21
#: Characters that end a unit, and how short a unit may be.
UNIT_END = re.compile("[\n\r\u2028\u2029。；！？.;!?]")
LEAST_UNIT = 10


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Hasher:
    """64-bit hashes of any stretches of one text, by prefix sums of a polynomial modulo 2**64."""

    sums: np.ndarray
    down: np.ndarray

    @classmethod
    def of(cls, chars: np.ndarray, seed: int = 1) -> Hasher:
        n = len(chars)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(seed)) * np.cumprod(np.full(n, _BASE)), out=sums[1:])
        return cls(sums, np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _BACK))]))

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def rolling(self, k: int) -> np.ndarray:
        n = len(self.sums) - 1
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.down[: n - k + 1]) if n >= k else np.empty(0, dtype=np.uint64)


def rolling(chars: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k characters."""
    return Hasher.of(chars).rolling(k)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of w values, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def units(text: str, least: int = LEAST_UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the lines and sentences of a text, without blanks at their ends and without the closing sign, from
    `least` characters on."""
    ends = [m.start() for m in UNIT_END.finditer(text)]
    begin, end = [], []
    for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(text)], strict=True):
        s = text[a:b]
        a, b = a + len(s) - len(s.lstrip()), b - len(s) + len(s.rstrip())
        if b - a >= least:
            begin.append(a)
            end.append(b)
    return np.array(begin, dtype=np.int64), np.array(end, dtype=np.int64)


def window_seeds(text: str, chars: np.ndarray, window: int, piece: int) -> np.ndarray:
    """For each window of a text a 64-bit seed that depends on the characters of the window alone.

    It is the smallest hash of the units that lie in the window together with the signs that part them from their
    neighbours, so that they are units wherever the window occurs. A window without a whole unit takes the smallest hash of
    its pieces of `piece` characters. Neighbouring windows mostly agree, so a text has few seeds.
    """
    n = len(chars) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    hashes = Hasher.of(chars)
    seeds, covered = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    cut = np.array([-1, *(m.start() for m in UNIT_END.finditer(text)), len(chars)], dtype=np.int64)
    begin, end = units(text)
    left, right = cut[np.searchsorted(cut, begin, "right") - 1], cut[np.searchsorted(cut, end)]
    own = hashes.between(begin, end)
    first, last = np.maximum(0, right + 1 - window), np.minimum(left, n - 1)  # windows that hold the signs at left and right
    fit = np.flatnonzero((left >= 0) & (right < len(chars)) & (first <= last))
    for i in fit[np.argsort(own[fit])[::-1]]:  # the smallest hash is painted last
        seeds[first[i] : last[i] + 1] = own[i]
        covered[first[i] : last[i] + 1] = True
    bare = np.flatnonzero(np.diff(np.concatenate([[True], covered, [True]]).astype(np.int8)))
    low, wide = np.uint64((1 << 24) - 1), window - piece + 1
    h = hashes.rolling(piece) if len(bare) else None
    for a, b in zip(bare[::2], bare[1::2], strict=True):
        for lo in range(int(a), int(b), CHUNK):
            hi = min(int(b), lo + CHUNK)
            part = h[lo : hi + wide - 1]
            at = sliding_min((part & ~low) | np.arange(len(part), dtype=np.uint64), wide) & low
            seeds[lo:hi] = mix(part[at.astype(np.int64)])  # mixed again: a piece is no unit
    return seeds
