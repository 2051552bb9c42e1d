"""Words, word hashes and shingles of whole texts, many texts at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_U = np.uint64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: An odd base, so that its powers have inverses modulo 2**64, and multipliers by place.
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=_U,
)
SHINGLE = len(_PLACES)
#: Texts are worked on together up to this many bytes; a longer one is worked on alone.
GROUP_BYTES = 1 << 20
_SLICE = 50_000


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all bits, one to one."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Texts(NamedTuple):
    """Some texts as bytes; text i lies between offsets i and i + 1."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """The words of some texts: number of the text, first and past-last byte."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[Texts]:
    """The texts of a column, nulls as empty, in groups of about ``limit`` bytes."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    column = column.fill_null("") if column.null_count else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Texts(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(texts: Texts) -> Words:
    inside = np.zeros(len(texts.data) + 2, dtype=bool)
    inside[1:-1] = _IS_WORD[texts.data]
    edge = np.zeros(len(texts.data) + 1, dtype=bool)
    edge[texts.offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return Words(np.searchsorted(texts.offsets, start, "right") - 1, start, end)


_POWERS = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def powers(n: int) -> list[np.ndarray]:
    """At least ``n`` powers of the base, and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(n, base, dtype=_U)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=_U)
    return _POWERS


def word_hashes(texts: Texts, found: Words) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased: polynomials in the bytes, from
    running sums, spread over all bits."""
    out = np.empty(len(found.start), dtype=_U)
    with np.errstate(over="ignore"):
        for i in range(0, len(out), _SLICE):
            start, end = found.start[i : i + _SLICE], found.end[i : i + _SLICE]
            low, high = start[0], end[-1]
            power, inverse = powers(1 << int(high - low + 1).bit_length())
            sums = np.zeros(high - low + 1, dtype=_U)
            byte = _LOWER[texts.data[low:high]].astype(_U) + _U(1)
            np.cumsum(byte * power[: high - low], out=sums[1:])
            out[i : i + _SLICE] = mix((sums[end - low] - sums[start - low]) * inverse[start - low])
    return out


def shingles(texts: Texts) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its five-word shingles; a text of fewer
    words has its whole sequence as one, a text without words none."""
    found = words(texts)
    hashes = word_hashes(texts, found)
    bounds = np.searchsorted(found.text, np.arange(len(texts.offsets)))
    out = []
    with np.errstate(over="ignore"):
        rows = np.zeros(max(0, len(hashes) - SHINGLE + 1), dtype=_U)
        for k, place in enumerate(_PLACES):
            rows += hashes[k : k + len(rows)] * place
        rows = mix(rows)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= SHINGLE:
                out.append(np.unique(rows[a : b - SHINGLE + 1]))
            elif b > a:
                short = (hashes[a:b] * _PLACES[: b - a]).sum(dtype=_U) + _U(int(b - a))
                out.append(mix(np.array([short], dtype=_U)))
            else:
                out.append(np.empty(0, dtype=_U))
    return out
