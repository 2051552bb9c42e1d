"""Bounded filters: sets of hashes as a bitmap.

A filter never loses a member. It takes PER bits or more for each, up to MOST bits; a set
that outgrows that lets more others through, which costs work and no rows: what passes is
always joined or compared exactly afterwards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the smallest filter and the largest, 16 MB, and bits taken for a member.
LEAST, MOST, PER = 1 << 18, 1 << 27, 32
_PAGE = 32768


def slot(key: Column) -> Column:
    """A number of 48 bits for any key, for filters of any size."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 48))


def bitmap(df: DataFrame, key: Column, per: int = PER) -> np.ndarray:
    """A filter of the non-negative numbers ``key`` of all rows of ``df``, which is read
    twice: its lowest bits say which bit is set."""
    bits = min(MOST, max(LEAST, 1 << (per * df.count()).bit_length()))
    place = F.pmod(key, F.lit(bits)) + 1
    page = F.bitmap_bucket_number(place).alias("page")
    packed = F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    out = np.zeros(bits // 8, dtype=np.uint8)
    pages = df.groupBy(page).agg(packed).toArrow()
    for number, part in zip(pages["page"].to_pylist(), pages["bits"]):
        part = np.frombuffer(part.as_py(), dtype=np.uint8)
        at = (number - 1) * (_PAGE // 8)
        out[at : at + len(part)] = part
    return out


def contains(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    places = keys.astype(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1
