"""Words as spans of bytes: classes of word bytes, joined copies, hashes of single words."""

from __future__ import annotations

import numpy as np

from tallyroom.llm.words import Texts, Words, mix

_U = np.uint64
#: Words are hashed together up to this many at a time.
SLICE = 50_000


def find(texts: Texts, is_word: np.ndarray) -> Words:
    """The runs of bytes that ``is_word`` (256 booleans) holds true; a run ends with its text."""
    inside = np.zeros(len(texts.data) + 2, dtype=bool)
    inside[1:-1] = is_word[texts.data]
    edge = np.zeros(len(texts.data) + 1, dtype=bool)
    edge[texts.offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(np.searchsorted(texts.offsets, start, "right") - 1, start, end)


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after the other, a space behind each, and where each begins there."""
    length = end - start
    begin = np.cumsum(length + 1) - length - 1
    out = np.full(int(length.sum()) + len(length), 32, dtype=np.uint8)
    if not len(start):
        return out, begin
    low, high = start[0], end[-1]
    inside = np.zeros(high - low + 1, dtype=np.int8)
    inside[start - low] += 1
    inside[end - low] -= 1
    filled = np.ones(len(out), dtype=bool)
    filled[begin + length] = False
    out[filled] = data[low:high][np.cumsum(inside[:-1], dtype=np.int8) == 1]
    return out, begin


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=_U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of the spans as they stand: polynomials in their bytes for an odd
    ``base``, from running sums, spread over all bits."""
    out = np.empty(len(start), dtype=_U)
    inverse = pow(base, -1, 2**64)
    with np.errstate(over="ignore"):
        for i in range(0, len(out), SLICE):
            a, b = start[i : i + SLICE], end[i : i + SLICE]
            low, high = a[0], b[-1]
            sums = np.zeros(high - low + 1, dtype=_U)
            np.cumsum((data[low:high].astype(_U) + _U(1)) * powers(base, high - low), out=sums[1:])
            out[i : i + SLICE] = mix((sums[b - low] - sums[a - low]) * powers(inverse, high - low + 1)[a - low])
    return out


def window_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hashes of every run of ``length`` consecutive word hashes (empty if there are fewer)."""
    n = len(words) - length + 1
    if n < 1:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, dtype=_U)
        np.cumsum(words * powers(base, len(words)), out=sums[1:])
        return mix((sums[length:] - sums[:-length]) * powers(pow(base, -1, 2**64), n))
