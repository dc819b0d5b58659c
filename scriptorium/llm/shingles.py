"""Hashed word shingles of texts, many texts at once in numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ _U(salt * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random 64-bit value for each byte, capitals as small letters.
_VALUE = mix(_LOWER.astype(np.uint64) + _U(1), 7)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        inverse = pow(int(_BASE), -1, 1 << 64)
        for i, b in enumerate((int(_BASE), inverse)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z lower-cased, and each text's first word.

    The second array has one entry more than there are texts. Nulls have no words.
    """
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    bounds = np.concatenate(([1], 1 + np.cumsum([len(r) + 1 for r in raw])))
    up, down = _power(len(data))
    sums = np.cumsum(_VALUE[data] * up[: len(data)])
    blank = _BLANK[data]
    first = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    last = np.flatnonzero(~blank[:-1] & blank[1:])
    hashes = mix((sums[last] - sums[first - 1]) * down[first] + (last - first + 1).astype(np.uint64))
    return hashes, np.searchsorted(first, bounds)


def shingle_lists(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct ``width``-word shingles of each text, as 64-bit hashes.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < 2_000_000):
            size += len(texts[end] or "")
            end += 1
        words, starts = word_hashes(texts[at:end])
        rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * _U(0xA24BAED4963EE407 * (2 * k + 1) & (1 << 64) - 1)
        rolled = mix(rolled, 1)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                factors = np.array([0xA24BAED4963EE407 * (2 * k + 1) & (1 << 64) - 1 for k in range(b - a)], dtype=np.uint64)
                out.append(mix((words[a:b] * factors).sum(dtype=np.uint64, keepdims=True), 100 + b - a))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        at = end
    return out


def in_both(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
