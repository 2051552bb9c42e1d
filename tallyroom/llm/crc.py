"""CRC-32 of many byte spans at once, from a table of bytes by distance from the end.

The register of CRC-32 is linear over XOR: what a byte adds to it depends on the byte and
on how many bytes follow, and what the start value and the final inversion add depends on
the length alone. So the CRC of a span is the XOR of one table entry a byte and one constant
of its length. The table covers REACH distances; a longer span is cut into blocks of REACH
bytes, counted from its end, whose sums are folded two by two, each time shifting the left
one over as many zero bytes as the right one has.
"""

from __future__ import annotations

import numpy as np

#: Distances from the end that the table holds: 64 x 256 entries of 4 bytes, 64 KB.
REACH = 64
_U = np.uint32
_ONES = _U(0xFFFFFFFF)
#: Reversed polynomial of CRC-32, as zlib and the operators' contracts have it (fixed value).
_POLYNOMIAL = 0xEDB88320


def _byte_steps() -> np.ndarray:
    step = np.arange(256, dtype=_U)
    for _ in range(8):
        step = np.where(step & 1, (step >> _U(1)) ^ _U(_POLYNOMIAL), step >> _U(1))
    return step


_STEP = _byte_steps()


def _next_zero(register: np.ndarray) -> np.ndarray:
    """The register after one zero byte more."""
    return (register >> _U(8)) ^ _STEP[register & _U(255)]


def _table() -> np.ndarray:
    rows = [_STEP]
    for _ in range(REACH - 1):
        rows.append(_next_zero(rows[-1]))
    return np.concatenate(rows)


#: Entry 256 * d + b: what byte b adds with d bytes behind it.
TABLE = _table()


class _Shift:
    """Registers moved over a fixed number of zero bytes: four tables, one a register byte."""

    def __init__(self, basis: np.ndarray):
        byte, bits = np.arange(256, dtype=np.int64)[:, None], np.arange(8)
        chosen = (byte >> bits) & 1 == 1
        self.tables = [
            np.bitwise_xor.reduce(np.where(chosen, basis[8 * k : 8 * k + 8], _U(0)), axis=1) for k in range(4)
        ]

    def __call__(self, register: np.ndarray) -> np.ndarray:
        out = self.tables[0][register & _U(255)]
        for k in (1, 2, 3):
            out = out ^ self.tables[k][(register >> _U(8 * k)) & _U(255)]
        return out


_BITS = _U(1) << np.arange(32, dtype=_U)
_SHIFTS = [_Shift(_next_zero(_BITS))]


def shift(power: int) -> _Shift:
    """Over 2 ** power zero bytes."""
    while len(_SHIFTS) <= power:
        last = _SHIFTS[-1]
        _SHIFTS.append(_Shift(last(last(_BITS))))
    return _SHIFTS[power]


def length_constants(lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of as many zero bytes as each length says."""
    distinct, which = np.unique(lengths, return_inverse=True)
    register = np.full(len(distinct), _ONES)
    for power in range(int(distinct[-1]).bit_length() if len(distinct) else 0):
        odd = (distinct >> power) & 1 == 1
        register[odd] = shift(power)(register[odd])
    return (register ^ _ONES)[which]


def _folded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of spans of any length, each at least one byte long, by blocks."""
    length = end - start
    blocks = -(-length // REACH)
    span = np.repeat(np.arange(len(length)), blocks)
    number = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(span))
    high = end[span] - number * REACH
    low = np.maximum(start[span], high - REACH)
    size = high - low
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first - low, size)
    behind = np.repeat(high - 1, size) - place
    total = np.bitwise_xor.reduceat(TABLE[(behind << 8) + data[place]], first)
    power = REACH.bit_length() - 1
    while len(total) > len(length):
        left = number & 1 == 1
        total[left] = shift(power)(total[left])
        number >>= 1
        change = np.ones(len(total), dtype=bool)
        change[1:] = (span[1:] != span[:-1]) | (number[1:] != number[:-1])
        at = np.flatnonzero(change)
        total, span, number, power = np.bitwise_xor.reduceat(total, at), span[at], number[at], power + 1
    return total


def crc32_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of ``data[start:end]`` for ascending spans, which must not overlap
    and hold a byte at least; bytes between spans are passed over."""
    if not len(start):
        return np.empty(0, dtype=_U)
    low, length = start[0], end - start
    gap = np.append(start[1:], end[-1]) - start
    behind = np.repeat(end - 1, gap) - np.arange(low, end[-1])
    held = (behind >= 0) & (behind < REACH)
    entry = np.where(held, behind << 8, 0) + data[low : end[-1]]
    added = TABLE[entry]
    added[~held] = 0
    total = np.bitwise_xor.reduceat(added, start - low)
    long = np.flatnonzero(length > REACH)
    if len(long):
        total[long] = _folded(data, start[long], end[long])
    return total ^ length_constants(length)
